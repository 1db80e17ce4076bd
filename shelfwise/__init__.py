"""shelfwise: retail analytics over order lines, written as PySpark DataFrame jobs."""

from shelfwise.tables import RetailTables

__all__ = ["RetailTables"]
