"""Operators for training data: quality, archives, duplicates, tokens, pages and mixtures."""
