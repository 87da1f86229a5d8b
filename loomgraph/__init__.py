"""Spark-first analytics over code graphs, documents, commits and usage telemetry."""

__version__ = "0.2.0"
