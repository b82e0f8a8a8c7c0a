"""termloom: a Spark-native engine for structured full-text retrieval and text-corpus processing."""

__version__ = "0.1.0"
