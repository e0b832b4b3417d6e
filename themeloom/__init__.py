"""Text-corpus analysis on Spark: ingest, topics, themes, clusters, retrieval."""

from themeloom.settings import Settings

__all__ = ["Settings"]
