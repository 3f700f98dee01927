"""Registered queries: name -> Spark job, and name -> oracle SQL where SQL can express it."""

from __future__ import annotations

import importlib

_MODULES = [
    "scans", "labels", "profiles", "pointintime", "live", "evaluation", "splits", "drift", "cohorts",
    "social", "retrieval", "rerank", "decisions", "quality", "modelling", "streams",
]


def _load() -> list:
    return [importlib.import_module(f"{__name__}.{name}") for name in _MODULES]


def queries() -> dict:
    out: dict = {}
    for m in _load():
        out.update(m.QUERIES)
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _load():
        out.update(m.ORACLE)
    return out
