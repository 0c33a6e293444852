"""Operators for preparing training text: counting, matching, deduplicating, filtering, scoring, packing and writing."""
