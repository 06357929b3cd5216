"""Ordered-data and text analytics as Spark DataFrame plans."""
