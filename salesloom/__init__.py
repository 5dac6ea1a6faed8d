"""Sales-table cleaning and analytics as Spark DataFrame operations."""

from salesloom.roles import SALES, Roles

__all__ = ["Roles", "SALES"]
