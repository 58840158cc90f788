"""Corpus jobs: DataFrame in, DataFrame out, keyed by document."""
