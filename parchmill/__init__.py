"""Spark-first text analytics: PDF text extraction and the tables built on it."""
