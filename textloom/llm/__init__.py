"""Operators for preparing training data: extraction, deduplication, packing, formatting, scoring, mixing."""
