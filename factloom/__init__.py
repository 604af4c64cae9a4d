"""Deterministic, content-addressed data and decisions on Spark."""
