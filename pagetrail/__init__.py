"""Analytics over stored web crawls, expressed as Spark DataFrame operations."""
