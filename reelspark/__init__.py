"""Analytics over libraries of production sound recordings and similar tables, on Spark."""
