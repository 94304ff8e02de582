"""Spark-native document ingestion, indexing and retrieval."""
