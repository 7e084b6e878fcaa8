from tallyforge.operators.totals import add_up, sum_rows, total_amount

__all__ = ["add_up", "sum_rows", "total_amount"]
