"""Chains of operators that answer one question about a signal."""
