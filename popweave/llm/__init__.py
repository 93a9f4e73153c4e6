"""Operators for preparing training text: joins, filters, tokens, models and their pipeline."""
