"""The queries of this subpackage and of the pipeline at the repository's top."""

from __future__ import annotations

import importlib

import corpus_pipeline

MODULES = ("pii", "near_dedup", "pieces", "suffix_tree", "exact_dedup", "quality", "packing", "sharding", "fingerprints", "language_id", "licenses", "hard_negatives", "collocations")


def collect(attribute: str) -> dict:
    out: dict = dict(getattr(corpus_pipeline, attribute))
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"parcelwise.llm.{name}"), attribute))
    return out
