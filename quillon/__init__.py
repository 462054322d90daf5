"""Spark-first engine for rule checks over document corpora and tables."""
