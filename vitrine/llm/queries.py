"""Queries of the matching, grouping, packing and labelling operators."""

from __future__ import annotations

import importlib

#: Modules of this package that hold a QUERIES dict.
MODULES = ["group_queries", "address_queries", "linkage_queries", "text_queries"]

QUERIES: dict = {}
for _name in MODULES:
    QUERIES |= importlib.import_module(f"vitrine.llm.{_name}").QUERIES
