"""Operators for preparing language-model training data, as Spark jobs."""
