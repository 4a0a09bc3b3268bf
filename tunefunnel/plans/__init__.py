"""Composed plans, shared written tables and the query registry."""
