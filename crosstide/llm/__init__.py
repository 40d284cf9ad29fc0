"""Operators for building language-model training data, their queries and the corpus pipeline."""
