"""Scalar functions and aggregates, each by static type as an expression of built-in functions."""
