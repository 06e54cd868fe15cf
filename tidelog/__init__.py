"""Message-log analytics on Spark: broker behaviour as functions from DataFrame to DataFrame."""
