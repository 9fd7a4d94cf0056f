"""Operators for preparing training data: scoring, near duplicates, filters and mixing."""
