"""Short utterances counted in bits against their paths, words of a text in one pass, and places of events without its words."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.operators import align
from murmura.operators import events as E

KIND = pa.list_(pa.string())


@pytest.mark.parametrize("words", [2, 4, 40])
def test_bitwise_counts_are_those_of_the_path(words, monkeypatch):
    rng = np.random.default_rng(words)
    ref = [[f"w{x}" for x in rng.integers(0, words, rng.integers(0, 66))] for _ in range(300)] + [[], ["a"], [], None, ["a"], ["b"] * 64, ["b"] * 65, ["a", None]]
    hyp = [[w if rng.random() < 0.7 else f"w{rng.integers(0, words)}" for w in r for _ in range(rng.integers(0, 3))] if k % 3 else [f"w{x}" for x in rng.integers(0, words, rng.integers(0, 90))] for k, r in enumerate(ref[:300])]
    sides = pa.array(ref, KIND), pa.array(hyp + [[], [], ["a"], ["a"], None, ["b"] * 70, ["b"] * 3, [None, "b"]], KIND)
    short = pa.array([r is None or len(r) <= align.BITS for r in ref])
    assert align.bitwise(*(s.filter(short) for s in sides)).tolist() == align.stepwise(*(s.filter(short) for s in sides)).tolist()
    got = align.edits.func(*sides)
    want = align.stepwise(*sides)
    assert [x.to_pylist() for x in got.flatten()] == want.tolist()


def test_short_pairs_have_no_tables(monkeypatch):
    def no(*_):
        raise AssertionError("a table for a short pair")

    monkeypatch.setattr(align, "cost_tables", no)
    got = align.edits.func(pa.array([["a", "b", "c"]] * 3, KIND), pa.array([["a", "c"], ["a", "x", "c", "d"], None], KIND))
    assert got.to_pylist() == [{"sub": 0, "del": 1, "ins": 0}, {"sub": 1, "del": 0, "ins": 1}, {"sub": 0, "del": 3, "ins": 0}]


def test_words_in_one_pass(spark):
    texts = ["", " ", "A b", "  Don't--stop now! ", "x\ty z\n", "a+b=c", "\U0001d7d8 \U0001f600 q", "...", "ÄÖ İstanbul ΣΑΣ", None, "a\x1cb\x85c"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for r in df.select(T.normalized_words(F.col("t")).alias("got"), T.words(T.normalized(F.col("t"))).alias("want")).collect():
        assert r.got == r.want


def test_placed_is_what_parsed_lists(spark):
    texts = ["", "a b", "[x]", "a [ Laugh ] b[y][z]c d\n[w]", "[]", "a [b", "a ] [b]", "[a [b] c]", "[ Ä ] é [q r] \U0001f600", None, "]x[", "w " * 3000 + "[t] w " * 3000]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "sample_id long, speaker string, tagged string")
    got, want = E.placed(df), E.listed(E.parsed(df))
    assert got.schema == want.schema
    assert sorted(got.collect()) == sorted(want.collect()) != []


def test_hit_counts_are_those_of_the_judged_events(spark):
    rng = np.random.default_rng(4)
    gold = [(s, f"p{s % 3}", str(rng.choice(list("hsx"))), int(rng.integers(30)), 30, e) for s in range(40) for e in range(rng.integers(8))] + [(99, "p0", None, 3, 30, 0)]
    found = [(s, int(g), t, float(rng.choice([0.2, 0.4, 0.6]))) for s in range(3, 44) for t in "hsy" for g in rng.choice(30, rng.integers(6), False)]
    events = spark.createDataFrame(gold, "sample_id long, speaker string, type string, gap long, n_words long, e int")
    fires = E.with_tolerance(spark.createDataFrame(found, "sample_id long, gap long, type string, prob double"), 0, 1)
    want = E.judged(events, fires).groupBy("sample_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("events"))
    assert sorted(E.hit_counts(events, fires).collect()) == sorted(want.collect()) != []
    assert E.hit_counts(events.limit(0), fires).collect() == []


def test_texts_are_cut_into_utterances_once(spark):
    """A filter on the cut text itself, which Spark puts before an explode, would split every text three times."""
    from murmura.plans import fixtures as X

    plan = X.utterances(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
