"""Operators for preparing training text: tokens, archives, languages, placement, privacy, duplicates."""
