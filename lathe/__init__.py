"""Spark-native table analytics."""

from lathe.operators.aggregate import GroupBy
from lathe.table import Table

__all__ = ["GroupBy", "Table"]
