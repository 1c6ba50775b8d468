"""Registered queries: each has a Spark form and, where SQL can say it, a DuckDB form."""

from __future__ import annotations

from importlib import import_module

MODULES = ["rollouts", "evaluation", "scoring", "corpora", "agents", "training", "tasks", "reducers", "losses", "timelines", "games", "operations", "answers", "products"]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__name__}.{m}").ORACLES.items()}
