"""Operators for preparing training text: counting, deduplication, filtering, scanning and mixing."""
