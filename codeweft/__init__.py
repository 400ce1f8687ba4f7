"""codeweft: a Spark-native engine for code knowledge graphs."""
