"""A Spark-native engine for text-corpus analytics over a recipe catalogue."""

__version__ = "0.1.0"
