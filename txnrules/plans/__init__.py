"""Registered queries and the SQL each one must agree with."""
