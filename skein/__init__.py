"""Skein: a Spark-native engine for coding-session transcripts."""

__version__ = "0.1.0"
