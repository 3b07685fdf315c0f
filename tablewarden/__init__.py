"""A Spark-native table data-quality engine."""
