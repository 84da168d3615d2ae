"""Point-in-time research data on PySpark."""
