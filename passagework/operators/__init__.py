"""Operators: chunks, postings, searches, fusion, results, maintenance and metrics."""
