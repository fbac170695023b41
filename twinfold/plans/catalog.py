"""All registered queries of the core and their SQL."""

from __future__ import annotations

from . import checks, code, families, prose, sections

_MODULES = (prose, sections, families, code, checks)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
