from tallyforge.plans.region_revenue import region_revenue

__all__ = ["region_revenue"]
