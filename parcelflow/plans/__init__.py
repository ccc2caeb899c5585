"""The query catalogue."""

from . import more  # noqa: F401 - adds its queries
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
