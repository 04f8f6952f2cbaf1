"""Analytics over append-only event journals, and text operators for training data, on Spark."""
