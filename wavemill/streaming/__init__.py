"""Stateful versions of the operators for Structured Streaming."""
