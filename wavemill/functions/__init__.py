"""Scalar functions: units, weighting curves and array helpers as column expressions."""
