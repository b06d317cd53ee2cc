"""Operators: each takes and returns DataFrames keyed by case_id."""
