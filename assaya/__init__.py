"""Integrity analytics for machine-learning data, as Spark DataFrame operators."""
