"""Registered queries of the de-identification engine and their DuckDB oracles."""

from . import model_queries, sink_queries
from .flow_queries import SQL
from .queries import ORACLES, QUERIES

ORACLES |= SQL

__all__ = ["ORACLES", "QUERIES", "model_queries", "sink_queries"]
