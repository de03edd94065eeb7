"""A PySpark engine for dynamic attributed networks."""
