"""Operators and queries for preparing training data. Nothing outside this package and ``corpus_pipeline.py`` imports it."""
