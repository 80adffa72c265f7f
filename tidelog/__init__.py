"""Evidence timeline analytics on Spark."""
