"""Operators for building training corpora, each a function between DataFrames."""
