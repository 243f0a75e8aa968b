"""Structured Streaming twins of the activity operators."""
