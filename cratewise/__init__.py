"""Music-library analytics on Spark."""
