"""Spark-native analytics over versioned repository knowledge graphs."""
