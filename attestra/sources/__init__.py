"""Readers and writers of the corpus tables."""
