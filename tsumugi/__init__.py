"""Spark-native engine for meaning-aware text matching and the data work around it."""
