"""Point-in-time analytics on Spark: market-data research operators and training-data preparation."""
