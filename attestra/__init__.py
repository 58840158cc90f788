"""Corpus-scale review of regulated batch documents on PySpark DataFrames."""
