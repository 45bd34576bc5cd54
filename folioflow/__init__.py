"""folioflow: a PySpark-native engine for bibliographic and document collections."""

__version__ = "0.1.0"
