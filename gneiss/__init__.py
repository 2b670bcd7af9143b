"""gneiss: Spark-native code and document search, ranking and corpus preparation."""

__version__ = "0.1.0"
