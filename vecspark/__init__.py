"""Spark-native compression, storage and exact search of embedding vectors."""

__version__ = "0.1.0"
