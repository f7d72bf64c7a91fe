"""Registered queries: importing this package fills the registry."""

from . import flows, graphs, logs, retrieval, store, text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
