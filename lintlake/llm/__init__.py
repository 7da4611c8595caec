"""Operators for preparing training data: filtering, deduplication, mixing, formatting."""
