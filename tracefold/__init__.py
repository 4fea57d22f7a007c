"""A Spark-native engine for versioned hybrid retrieval over code and text."""

__version__ = "0.1.0"
