"""Event-flow analytics on Spark: flows in a small language become DataFrame plans."""
