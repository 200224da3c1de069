"""All registered queries."""

from . import catalog_data, catalog_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
