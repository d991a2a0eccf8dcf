"""Models trained on Spark."""
