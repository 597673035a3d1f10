"""Operators for building training data, with their queries and SQL."""
