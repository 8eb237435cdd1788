"""Relational operators of the memory engine over DataFrames."""
