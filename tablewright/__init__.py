"""Data-quality and exploratory analytics as Spark DataFrame operators."""
