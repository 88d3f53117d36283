"""Semantic change analytics over versioned design files, on Spark."""

__version__ = "0.1.0"
