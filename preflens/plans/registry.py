"""All registered queries by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import importlib

MODULES = ("evaluation", "sampling", "similarity", "content", "tabular")


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        part = importlib.import_module(f"preflens.plans.{name}").QUERIES
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _all().items() if text}
