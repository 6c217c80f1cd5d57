"""Queries and oracles of the training-data operators. ``load()`` imports every
query module and returns (queries, oracles)."""
from __future__ import annotations

import importlib

_MODULES = ["q_quality", "q_linededup", "q_neardup", "q_mixing", "q_packing", "q_chat", "q_fingerprint",
            "q_secretscan", "q_license", "q_htmltext", "q_decontam",
            "q_repair", "q_aligned"]

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load():
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")
    import corpus_pipeline
    QUERIES["pipeline"] = corpus_pipeline.run
    return QUERIES, ORACLES
