"""A document query engine on PySpark."""
