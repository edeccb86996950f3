"""A Spark-native engine for digital-forensics data and large text corpora."""

__version__ = "0.1.0"
