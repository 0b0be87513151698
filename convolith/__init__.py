"""convolith: a Spark-native archive and analytics engine for chat conversations."""

__version__ = "0.1.0"
