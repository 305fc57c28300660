"""Operators for preparing training text: filtering, deduplication, tokenizing, packing."""
