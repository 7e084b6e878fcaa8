from tallyforge.functions.money import discounted_amount, hundredths

__all__ = ["discounted_amount", "hundredths"]
