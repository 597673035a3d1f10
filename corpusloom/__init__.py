"""Versioned-text analytics expressed as Spark DataFrame plans."""
