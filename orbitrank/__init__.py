"""Embedding retrieval and its evaluation as DataFrame operators on Spark."""
