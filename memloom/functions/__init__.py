"""Scalar building blocks as Column expressions."""
