"""Named queries over the star-schema tables, with an equivalent SQL text where one exists."""

from __future__ import annotations

import importlib

FAMILIES = ("quality", "drifts", "scoring", "fair", "release", "streams")


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"wardline.plans.{name}")


def queries() -> dict:
    from wardline.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from wardline.plans.registry import SQL

    _load()
    return dict(SQL)
