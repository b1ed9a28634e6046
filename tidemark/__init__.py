"""Tidemark: a Spark-native SQL, key-value and log-processing engine."""
