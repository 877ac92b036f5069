"""Relational operators: filters, joins, groupings, windows and orderings."""
