"""Time-series analytics over many keyed series on Spark."""
