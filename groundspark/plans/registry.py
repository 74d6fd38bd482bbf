"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

import importlib

FLAGSHIP = "evidence_pack"
MODULES = ("analytics", "corpus", "retrieval", "sections", "planning", "concepts", "builds", "streams")


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what)()
    return out


def queries() -> dict:
    return _all("queries")


def oracle_sql() -> dict[str, str]:
    return _all("oracle_sql")
