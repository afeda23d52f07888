"""Operators for preparing training text: scoring, search, deduplication, masking, mixing and encoding."""
