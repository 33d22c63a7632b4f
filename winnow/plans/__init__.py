"""Whole plans made of operators, and the queries the driver checks."""
