"""Timed-text (subtitle and caption) corpora as Spark DataFrame jobs."""

__version__ = "0.3"
