"""The corpus pipeline: documents through five stages, each of which reads what the one before has written."""

from __future__ import annotations

import uuid

from murmura.llm import byte_bpe, mixing, quality, secrets, simhash
from murmura.llm.shared import shared_dir

STAGES = [
    ("quality rules", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("secret scans", secrets.stage),
    ("mixing sources to target weights", mixing.stage),
    ("byte-level BPE", byte_bpe.stage),
]

#: SQL can't express byte-level BPE; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
