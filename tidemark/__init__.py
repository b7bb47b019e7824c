"""tidemark: a PySpark-native engine for recall and activity analytics."""

__version__ = "0.1.0"
