"""Spark-first analytics for labelled sparse matrices, genomic intervals and training data."""

__version__ = "0.1.0"
