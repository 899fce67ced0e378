"""Operators for preparing training data at large scale; optional, nothing outside imports it."""
