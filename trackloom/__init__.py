"""Analytics over recorded multi-ship matches, as Spark DataFrame operations."""
