"""Whole plans: combined search, and the catalogue of queries with their SQL."""
