"""Keyed state over dialogue and event streams."""
