"""Gleaner: a document retrieval and corpus engine expressed as Spark DataFrames."""

__version__ = "0.1.0"
