"""Readers that turn text exports into typed DataFrames, and writers."""
