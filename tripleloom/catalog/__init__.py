"""Queries over the driver tables, each with its SQL statement where one exists."""

from tripleloom.catalog import bronze, changes, maps, rules, silver, text, views
from tripleloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bronze", "changes", "maps", "rules", "silver", "text", "views"]
