"""All registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("series", "panels", "sampling", "risks", "operations", "books", "managers")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tidemark.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
