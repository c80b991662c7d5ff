"""Spark-first engine for contextual retrieval: ingest, chunk, index, search, measure."""

__version__ = "0.1.0"
