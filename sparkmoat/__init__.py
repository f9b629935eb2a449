"""A Spark-native engine that inspects and cleans text around language models."""

__version__ = "0.1.0"
