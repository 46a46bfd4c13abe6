"""All queries of the engine by name, each with the SQL that checks it."""

from __future__ import annotations

from . import calibration, crowd, evaluation, files, history, learning, reshaping, retrieval, routing, runs, sampling, scalars, streams, voting  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
