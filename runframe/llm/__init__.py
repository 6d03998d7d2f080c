"""Operators for preparing language-model training text: scoring, deduplication, filtering, encoding."""
