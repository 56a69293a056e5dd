"""Named queries over the given tables, with the SQL they must agree with."""

from __future__ import annotations

import importlib

MODULES = ("tables_checks", "preparation", "evaluation", "training", "reading", "scoring")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tabweave.plans.{m}")


def all_queries():
    from tabweave.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from tabweave.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
