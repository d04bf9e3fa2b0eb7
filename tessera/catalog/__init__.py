"""Named queries of the engine over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from . import discovery, files, matrix, motif_files, names, networks, results, runs, scores
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "discovery", "files", "matrix", "names", "networks", "results", "runs", "scores"]
