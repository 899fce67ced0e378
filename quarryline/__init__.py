"""Spark engine for navigating, searching and measuring large text corpora."""
