"""Corpora, front-matter, configuration, tables."""
