"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("loss", "spatial", "solar", "hazard", "trade", "evaluation", "tables", "sources")


def collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"workloads.{name}"), attribute))
    return out
