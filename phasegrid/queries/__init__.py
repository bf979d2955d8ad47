"""Registered queries over the driver tables, each with its DuckDB statement where SQL can express it."""

from __future__ import annotations

import importlib

from phasegrid.queries.registry import ORACLE, QUERIES

for _name in ("profiling", "preparing", "encoding", "measuring", "scoring", "evaluating", "documents", "storing", "training"):
    importlib.import_module(f"phasegrid.queries.{_name}")

__all__ = ["ORACLE", "QUERIES"]
