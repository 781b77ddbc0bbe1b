"""Spark-native engine for record validation, scoring and corpus preparation."""
