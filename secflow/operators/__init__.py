"""Relational operators: sliding windows, joins, sets, aggregates."""
