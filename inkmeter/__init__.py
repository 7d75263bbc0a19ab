"""Recognised-text evaluation and corpus preparation on Spark."""
