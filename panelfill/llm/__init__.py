"""Operators for preparing training text: decontamination, quality, duplicates, tokens, addresses and personal data."""
