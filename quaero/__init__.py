"""Spark-native analytics over a corpus of crawled pages and documents."""

__version__ = "0.1.0"
