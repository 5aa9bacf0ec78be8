"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

import importlib

from murmura.llm import registry

MODULES = ("byte_bpe", "embeddings", "language", "lm_score", "mil_quality", "mixing", "quality", "ranked_search", "secrets", "simhash", "suffix", "token_alignment", "token_counts")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"murmura.llm.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
