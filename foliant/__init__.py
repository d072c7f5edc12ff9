"""Spark-native batch engine for catalogue linking and point-in-time features."""

__version__ = "0.1.0"
