"""Importing this module registers every query."""

from voxelframe.catalog import jobs, models, quality, tables, texture, volume  # noqa: F401
from voxelframe.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
