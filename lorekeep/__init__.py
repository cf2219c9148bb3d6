"""A Spark-native engine for long-term, dated and attributed organisational memory."""
