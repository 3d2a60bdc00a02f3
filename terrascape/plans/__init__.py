"""Whole indicators, and the queries that are registered for them."""
