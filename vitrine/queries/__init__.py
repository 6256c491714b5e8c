"""Registered queries: name -> (function of session and folder, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

#: Modules of this package that hold a QUERIES dict.
MODULES = ["core_problems", "change_queries", "listing_queries", "text_function_queries"]


def registry() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"vitrine.queries.{name}").QUERIES
    return out
