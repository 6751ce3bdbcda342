"""App-store review analytics on Spark."""
