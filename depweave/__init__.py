"""Spark operators for code-dependency graphs and the tables around them."""
