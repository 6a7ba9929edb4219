"""Structured Streaming over the event ledger."""
