"""Operators over DataFrames: spans, tokens, vault, rehydration, payloads."""
