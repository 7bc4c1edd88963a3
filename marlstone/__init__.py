"""Spark-native engine for sites of documentation and for large text corpora."""
