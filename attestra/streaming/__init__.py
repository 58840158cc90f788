"""Structured Streaming jobs for submissions and results."""
