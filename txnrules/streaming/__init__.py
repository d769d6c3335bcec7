"""Structured Streaming: transactions that arrive over time."""
