"""lexora: a PySpark-native engine for text-quality and spelling analytics."""

__version__ = "0.1.0"
