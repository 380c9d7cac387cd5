"""Analytics for event logs and small text corpora, on Spark."""
