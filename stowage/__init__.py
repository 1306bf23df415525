"""Spark-native analytics over archive manifests: members, chunks, digests and layout."""

__version__ = "0.1.0"
