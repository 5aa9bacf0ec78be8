"""Recall of the projection passes, and every query on tables with columns whose names the operators use themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura import llm
from murmura.llm import embeddings


@pytest.mark.parametrize(("pairs", "window"), [(400, 16), (3000, 16), (3000, embeddings.WINDOW)])
def test_recall_of_pairs_at_the_threshold(spark, pairs, window):
    """Pairs just above the threshold among strangers, in windows that hold a small part of all vectors, as windows of many more rows would."""
    rng = np.random.default_rng(pairs)
    a = rng.standard_normal((pairs, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal((pairs, 64))
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.9505 * a + np.sqrt(1 - 0.9505**2) * other
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), passes=embeddings.passes_for(2 * pairs, 0.95, window), window=window).select("vec_id", "n_links").collect()}
    assert sum(got[k] == got[k + pairs] == 1 for k in range(pairs)) >= 0.98 * pairs


NAMES = ["a", "b", "c", "n", "m", "v", "t", "p", "q", "k", "fp", "row", "key", "kind", "batch", "range", "doc", "sum", "at", "size", "target", "taken", "terms", "counts", "pairs", "times", "item", "rank", "score", "held_out", "stratum", "kept", "place", "component", "n_tokens", "unit", "least", "label", "bag", "_row"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) + (" api_key: AbCd1234EfGh5678" if i % 9 == 0 else "") + (" zzz" * 40 if i % 7 == 0 else ""), rng.choice(["en", "fr"]), rng.choice(["s", "t", None]), 5) for i in range(150)]
    docs += [(200 + i, docs[i][1], "en", "s", 5) for i in range(5)] + [(300, None, None, None, None), (301, "", "fr", "t", 0)]
    vectors = [(i, np.random.default_rng(i % 20).standard_normal(8).tolist(), 0) for i in range(40)]
    out = []
    for clash in (False, True):
        base = str(tmp_path_factory.mktemp("sf"))
        extra = lambda df: df.withColumns({c: F.lit(f"x{c}") for c in NAMES if c not in df.columns}) if clash else df  # noqa: E731, B023
        extra(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")).repartition(2).write.parquet(f"{base}/documents.parquet")
        extra(spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")).write.parquet(f"{base}/labels.parquet")
        extra(spark.createDataFrame([(i, docs[i * 3][1]) for i in range(10)], "item_id long, text string")).write.parquet(f"{base}/benchmark.parquet")
        extra(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")).write.parquet(f"{base}/embeddings.parquet")
        out.append(base)
    return out


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_clashing_names_change_nothing(spark, folders, name):
    plain, clash = (sorted(map(repr, llm.queries()[name](spark, f).collect())) for f in folders)
    assert plain == clash and plain
