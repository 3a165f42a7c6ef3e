"""karst: a PySpark-native engine for graph retrieval, ranking and evaluation."""

__version__ = "0.1.0"
