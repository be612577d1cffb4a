"""Data-quality checks as PySpark DataFrame operators."""

from tablegauge import functions, operators, plans, sources

__all__ = ["functions", "operators", "plans", "sources"]
