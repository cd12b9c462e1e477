"""Numeric building blocks. Arguments are column names or SQL expressions, results are columns."""
