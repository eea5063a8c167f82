"""Integer-signal analytics on Spark."""
