"""All queries over the corpus operators and their DuckDB twins."""

from __future__ import annotations

import importlib

from stridelake.plans.base import ORACLE_SQL, QUERIES

for _name in ("series", "detection", "statistics", "scalars", "relations", "selection", "grouped", "streams", "files", "effectors", "curation", "diversity", "kinematics", "scans", "sql_text"):
    importlib.import_module(f"stridelake.plans.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
