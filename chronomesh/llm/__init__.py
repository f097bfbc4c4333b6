"""Operators for preparing training text and media; nothing outside imports this package."""
