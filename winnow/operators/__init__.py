"""Operators: f(df, ...) -> DataFrame."""
