"""All registered queries with their SQL."""

from __future__ import annotations

from ..operators import audits, calibration, decode, dimensions, learning, pipeline, robustness, text, traders, vectors

MODULES = (calibration, pipeline, traders, learning, text, vectors, audits, decode, robustness, dimensions)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
