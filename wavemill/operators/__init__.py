"""Operators over signals, frames, features and events."""
