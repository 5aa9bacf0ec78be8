"""Models behind small interfaces: recognisers and others are registered by name, or named as module:Class, and run as metrics.

A backend says what it is (describe(), which results depend on), loads itself once in each Python worker (setup()) and takes a batch of
clips at a time (run(rows), a frame with sample_id, rate and x, an array of samples each), giving a dict for each clip in order.
"""

from __future__ import annotations

import importlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.operators import acoustics
from murmura.sources import audio, results

#: What backends of each kind give for a clip.
KINDS = {
    "asr": "text string, tokens array<string>, times array<double>, duration double",
    "pmos": "sig double, bak double, ovrl double, p808 double",
    "embedding": "u array<double>",
}
_REGISTERED: dict[tuple[str, str], type] = {}


class Backend:
    """One model. Clips come at the rate that it asks for."""

    kind = "asr"
    rate = acoustics.RATE

    def describe(self) -> dict:
        """What tells one model and its settings from another."""
        raise NotImplementedError

    def setup(self) -> None:
        """Loads the model."""

    def run(self, rows: pd.DataFrame) -> list[dict]:
        raise NotImplementedError


def register(name: str):
    """Registers a class of backends under its kind and name."""

    def add(cls: type) -> type:
        if cls.kind not in KINDS:
            raise ValueError(f"unknown kind of backend: {cls.kind}")
        _REGISTERED[cls.kind, name] = cls
        return cls

    return add


def create(kind: str, name: str, **settings) -> Backend:
    """The backend of that name, or of the class that module:Class names."""
    if (kind, name) not in _REGISTERED and ":" in name:
        module, cls = name.split(":", 1)
        own = getattr(importlib.import_module(module), cls)
    else:
        own = _REGISTERED.get((kind, name))
    if own is None or own.kind != kind:
        raise ValueError(f"no {kind} backend {name!r}; there are {sorted(n for k, n in _REGISTERED if k == kind)}")
    return own(**settings)


class Modelled(results.Metric):
    """A backend as a metric."""

    def __init__(self, backend: Backend, version: int = 1):
        self.backend, self.name, self.version, self.schema = backend, backend.kind, version, KINDS[backend.kind]

    def describe(self) -> dict:
        return {"kind": self.backend.kind, "rate": self.backend.rate, **self.backend.describe()}

    def setup(self) -> None:
        self.backend.setup()

    def batch(self, rows: pd.DataFrame) -> list[dict]:
        return self.backend.run(rows[["sample_id", "rate", "x"]])


def heard(found: DataFrame, rate: int) -> DataFrame:
    """sample_id, rate, x and missing (why there are no samples) of files (sample_id, content), a clip a row."""
    own = acoustics.resampled(audio.decoded(found.withColumnRenamed("sample_id", "clip"), rate, None), rate)
    return own.select(F.col("clip").alias("sample_id"), "rate", "x", F.col("error").alias("missing"))


def run(backend: Backend, found: DataFrame, path: str, version: int = 1) -> DataFrame:
    """The backend's results for files (sample_id, content) under path, reused while model and files are the same."""
    from murmura.operators.manifest import fingerprint

    inputs = fingerprint(found.select("sample_id", F.sha2("content", 256).alias("h")), ["sample_id", "h"]).first()
    return results.run(Modelled(backend, version), heard(found, backend.rate), path, inputs["digest"] if inputs else "")
