"""Steps that have to stay small as their input grows: what is kept, draws, long alignments, texts sent to Python."""

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from murmura.functions import draws as D
from murmura.functions import text as T
from murmura.operators import align, nvpa, timing, vectors
from murmura.operators import events as E
from murmura.plans import fixtures as X
from murmura.storage import kept

DATA = "/root/testdata/sf0.001"


def test_kept_rows_are_columns(spark):
    df = spark.range(5000).select(F.lit("the same words again").alias("t"), "id")
    again = kept(df)
    files = again.inputFiles()
    assert files and all(f.endswith(".parquet") for f in files) and again.count() == 5000 and again.dtypes == df.dtypes


def test_speech_keeps_windows_only(spark):
    """Words, times and alignment are gone once windows are known, and nothing but detections is joined."""
    ready = nvpa.centred(nvpa.prepared(*X.tagged_utterances(spark, DATA)))
    assert {"pairs", "heard", "ref"}.isdisjoint(ready.columns) and "centres" in ready.columns


def test_draws_are_those_of_the_hash():
    rng = np.random.default_rng(2)
    for columns in ([3, np.arange(2000)], [rng.integers(0, 20, 500), rng.integers(0, 10**7, 500), np.arange(500)], [np.array(["a", "ü"]), np.array([1, 2])], [np.array([-3, 5, 10**17])], [np.arange(2) + 10**17] * 4):
        for digits in (8, 15):
            got = D.hashed(7, *columns, digits=digits)
            rows = zip(*(np.broadcast_to(np.asarray(c), len(got)).tolist() for c in columns), strict=True)
            assert got.tolist() == [int(hashlib.md5("|".join(["7", *map(str, r)]).encode()).hexdigest()[:digits], 16) for r in rows]


def test_waves_give_the_path_of_the_table():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = ([str(x) for x in rng.integers(0, rng.integers(1, 9), rng.integers(0, 40))] for _ in range(2))
        sides = pa.array([a, a], pa.list_(pa.string())), pa.array([b, a[3:]], pa.list_(pa.string()))
        for cells in (10**7, 40):
            table, waves = align.walked(*sides, cells, 10**9), align.walked(*sides, cells, 0)
            assert all((x[t[-1]] == y[w[-1]]).all() for t, w in [(table, waves)] for x, y in zip(t[:3], w[:3], strict=True))


def test_a_long_pair_takes_few_numbers():
    words = np.random.default_rng(1).integers(0, 3000, 20_000)
    found = align.waves(words, np.delete(words, np.arange(0, 20_000, 25)), 8_000_000)
    assert found is not None and sum(map(len, found[0])) < 20_000 * 200


def test_only_texts_that_may_change_are_sent_to_python(spark):
    texts = ["plain", "Äußerst höflich – “café”", "café", "한", "Ελλάδα Москва", "中文", "̈́", "á̧", "\U0001d15e", "q̣̇"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(T.unsettled()).alias("sent"), T.nfc(F.col("t")).alias("n")).collect()
    assert all(r.n == unicodedata.normalize("NFC", r.t) for r in rows) and all(r.sent for r in rows if r.n != r.t)
    assert [r.sent for r in rows[:2]] == [False, False] and not rows[5].sent


def test_gap_map_and_words_of_odd_pieces(spark):
    raw = [["-", "a-b", "c"], [], ["a\nb", "", "x y"], ["...", "ὈΔΥΣΣΕΎΣ"], [None, "a"]]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "w array<string>").select(timing.gap_map(F.col("w"))).collect()]
    assert got == [[0, 0, 2, 3], [0], [0, 2, 2, 4], [0, 0, 1], [0, 0, 1]]
    tokens = [(["▁a-", "b", " C", "▁"], [0.0, 0.5, 1.0, 2.0]), ([], []), (None, None), (["x"], [1.0, 2.0]), (["▁...", "▁Σ", "Σ"], [0.0, 1.0, 2.0])]
    got = [r[0] and [tuple(x) for x in r[0]] for r in spark.createDataFrame(tokens, "t array<string>, at array<double>").select(timing.token_words(F.col("t"), F.col("at"))).collect()]
    assert got == [[("a", 0.0, 0.5), ("b", 0.0, 0.5), ("c", 1.0, 1.0)], None, None, None, [("σς", 1.0, 2.0)]]


def test_references_are_summed_once_a_list(spark):
    """Samples that share their references make no rows of their own for each reference or component."""
    clips = spark.range(4).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("clip"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("u"), F.lit(2.0).alias("seconds"))
    samples = spark.range(1000).select(F.col("id").alias("sample_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("u"), F.when(F.col("id") < 998, F.array(F.lit("c0"), F.lit("c3"))).when(F.col("id") == 998, F.array(F.lit("c0"), F.lit("none"))).alias("refs"))
    rows = {r.sample_id: r for r in vectors.similarity(samples, clips).collect()}
    assert len(rows) == 1000 and rows[0].n_ref_clips == 2 and rows[0].ref_seconds == 4.0 and abs(rows[0].cosine - 2 / 13**0.5) < 1e-12
    assert rows[998].error == rows[999].error == "missing reference" and rows[999].cosine is None


def test_nearest_detection(spark):
    events = spark.createDataFrame([(1, "a", 0, 5), (1, "a", 1, 20), (1, "b", 2, 5), (2, "a", 0, 5), (1, None, 3, 5)], "sample_id long, type string, e int, gap long")
    found = spark.createDataFrame([(1, "a", 3, 0.5), (1, "a", 7, 0.5), (1, "a", 26, 0.5), (1, "b", 10, 0.5), (3, "a", 5, 0.5)], "sample_id long, type string, gap long, prob double")
    assert {(r.sample_id, r.e): r.shift for r in E.offsets(events, found).collect()} == {(1, 0): -2, (1, 1): None, (1, 2): 5, (2, 0): None, (1, 3): None}


def test_placement_summary_parses_texts_once(spark, monkeypatch):
    from murmura.plans import placement

    calls, parsed = [], X.parsed
    monkeypatch.setattr(X, "parsed", lambda *a: calls.append(a) or parsed(*a))
    assert placement.placement_summary(spark, DATA).count() == 1 and len(calls) == 1
