"""Plans of file actions, computed as DataFrames and executed apart from the query."""
