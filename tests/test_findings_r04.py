"""What the findings of round 4 were about: replicates, files that only tasks know of, windows summed where they are found, speech without rows for tokens."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmura import registry
from murmura.functions import draws as D
from murmura.functions import text as T
from murmura.operators import align, nvpa, stats, timing
from murmura.plans import fixtures as X
from murmura.plans import placement, timings
from murmura.sources import sink

DATA = "/root/testdata/sf0.001"


def test_intervals_by_type_have_the_replicates_of_the_evaluation(spark, monkeypatch):
    """As many as the evaluation draws for intervals by group, in code and SQL."""
    seen = []
    monkeypatch.setattr(placement, "outcomes", lambda *_: spark.createDataFrame([(1, 0, "a", True, "s")], "sample_id long, e long, type string, hit boolean, speaker string"))
    monkeypatch.setattr(stats, "intervals", lambda rows, by, reps, seed: seen.append(reps) or rows.select("type", *[F.lit(0.0).alias(c) for c in ("reps", "value", "ci_low", "ci_high", "cluster_low", "cluster_high")]))
    placement.placement_intervals(spark, DATA)
    assert seen == [500] and registry.oracles()["placement_intervals"].count("range(500)") == 2


@pytest.mark.parametrize("stretch, pieces", [(1000, 16), (1, 3)])
def test_draws_of_a_replicate_come_in_pieces(spark, monkeypatch, stretch, pieces):
    """A replicate that several tasks draw is the same as one that a single task draws, with a row for each block and piece at most."""
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("key"), (F.col("id") % 7).alias("num"), F.lit(1).alias("den"))
    whole = {r.rep: r for r in stats.replicates(df, ["g"], 6, 3).collect()}
    monkeypatch.setattr(stats, "STRETCH", stretch)
    monkeypatch.setattr(stats, "PIECES", pieces)
    assert {r.rep: r for r in stats.replicates(df, ["g"], 6, 3).collect()} == whole and len(whole) == 6
    assert all(r.drawn == 5000 for r in whole.values())


def test_hashes_of_single_and_many_counters_agree():
    i = np.r_[np.arange(95, 105), np.arange(10**9 - 3, 10**9 + 3)]
    for rep in (0, 12):
        assert (D.hashed(6, rep, i, np.int64(4), digits=15) == D.hashed(6, np.full(len(i), rep), i, np.full(len(i), 4), digits=15)).all()


def test_files_are_neither_listed_nor_named_by_the_driver(spark, tmp_path, monkeypatch):
    """Files are put in place and read by tasks: the driver sees no name, whatever their number."""
    rows = spark.range(300).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("name"), F.repeat(F.lit("x"), F.col("id").cast("int")).cast("binary").alias("content"))
    seen, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    names = sink.write(rows, str(tmp_path / "out"))
    found = sink.read(names, str(tmp_path / "out"))
    assert max(map(len, seen)) <= 1 and not [p for p in found.inputFiles() if p.startswith(f"file://{tmp_path}")]
    assert found.where("length(content) = split(name, '/')[1]").count() == 300 == len(list((tmp_path / "out" / "d").iterdir()))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["d"]


def test_a_move_that_runs_again_goes_on(tmp_path):
    """A task whose first attempt has moved some of its files moves the others."""
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "b").write_bytes(b"2")
    (tmp_path / "a").write_bytes(b"1")
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([f"{tmp_path}/s"] * 2)], names=["name", "folder"])
    assert [b.column("n").to_pylist() for b in sink.moved(str(tmp_path))([batch])] == [[2]]
    assert (tmp_path / "a").read_bytes() + (tmp_path / "b").read_bytes() == b"12"


def test_words_are_measured_as_spark_cuts_them(spark):
    blanks = [" ", "\t", "\n", "\x0b", "\r", *map(chr, (0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
    others = ["a", "bcdefg", *map(chr, (1, 0x1C, 0x7F, 0x85, 0xE0, 0xC2, 0x180E, 0x200B, 0x2010, 0x3001, 0x65E5, 0x1F600))]
    rng = np.random.default_rng(1)
    texts = ["", None, " ", "a", chr(0xA0), *["".join(rng.choice(blanks + others * 2, rng.integers(1, 30))) for _ in range(300)], None]
    want = [(r.i, x) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.transform(T.words(F.col("t")), F.length).alias("n")).orderBy("i").collect() for x in r.n or []]
    owner, size = T.word_sizes(pa.array(texts, pa.string()).slice(0))
    assert list(zip(owner.tolist(), size.tolist(), strict=True)) == want
    assert [x.tolist() for x in T.word_sizes(pa.array(texts, pa.string()).slice(5, 50))] == [[i - 5 for i, _ in want if 5 <= i < 55], [n for i, n in want if 5 <= i < 55]]


def test_windows_are_added_up_where_they_are_found(spark):
    """No row for each window, nor for each utterance, goes from step to step."""
    plan = registry.queries()["gap_windows"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    empty = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string").mapInArrow(timings.summed_windows, timing.TOTALS)
    assert empty.collect() == []


def test_speech_counted_in_one_pass_is_what_the_operators_find(spark):
    """Counts by type, speaker and reason, seconds, spurious detections and samples: as prepared() and outcomes() give them row by row."""
    ready = nvpa.centred(nvpa.prepared(*X.tagged_utterances(spark, DATA))).cache()
    events = ready.where("error IS NULL").select("sample_id", F.inline("events")).withColumn("gap", F.col("gap").cast("long"))
    judged, left = nvpa.outcomes(ready, X.detected(events), X.thresholds(spark), 0, 1, 0.75)
    want = {(r.type, r.speaker, r.reason): (r.n, r.timed, pytest.approx(r.seconds)) for r in judged.groupBy("type", "speaker", "reason").agg(F.count("*").alias("n"), F.count("sec_offset").alias("timed"), F.coalesce(F.sum(F.abs("sec_offset")), F.lit(0.0)).alias("seconds")).collect()}
    every = timings.in_speech(spark, DATA).groupBy("type", "speaker", "reason").agg(*[F.sum(c).alias(c) for c in ("n", "timed", "seconds", "spurious", "words", "samples", "failed", "no_timing")]).collect()
    assert {(r.type, r.speaker, r.reason): (r.n, r.timed, r.seconds) for r in every if r.reason} == want
    rest, = (r for r in every if r.reason is None)
    one = ready.agg(F.count("*"), F.count("error"), F.count_if(F.col("no_timing") & F.col("error").isNull()), F.sum(F.when(F.col("error").isNull(), F.col("n_ref")))).first()
    assert (rest.samples, rest.failed, rest.no_timing, rest.words, rest.spurious) == (*one, left.count())


def test_speech_moves_no_text(spark):
    """Texts are read once and dealt at most once; before the counts nothing is joined, gathered or written."""
    plan = timings.in_speech(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange") <= 1 and plan.count("Scan parquet") == 1


def test_pairs_of_words_are_those_of_the_table():
    rng = np.random.default_rng(8)
    sides = [pa.array([list(map(str, rng.integers(0, 5, rng.integers(0, 80)))) for _ in range(200)], pa.list_(pa.string())) for _ in range(2)]
    pair, i, j = align.matched(*sides)
    own = align.walked(*sides)
    both = (own[1] >= 0) & (own[2] >= 0)
    assert sorted(zip(pair.tolist(), i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(x[both].tolist() for x in own[:3]), strict=True))


ODD = ["abcd" + chr(0x2581) + "efghij", chr(0x2581), "a-b", "...", "Caf" + chr(0xE9) + "s", "don't", "[", "]", "1,000", "a" + chr(0xA0) + "b", "word", "sixsix", "\n", "\t", ", ", ". ", " ", chr(0x65E5) + chr(0x672C), "$$"]


@pytest.mark.parametrize("name", ["speech_reasons", "speech_summary", "gap_windows"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    """Texts without words, with marks only, with blanks inside tokens and with what begins a token inside a word."""
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "[", *["".join(x + (" " if rng.random() < 0.6 else "") for x in rng.choice(ODD, rng.integers(1, 300))) for _ in range(60)]]
    rows = [(k, t, "s%d" % (k % 3)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours, theirs = registry.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(registry.oracles()[name]).df()
    shown = lambda df: sorted(repr([None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert shown(ours) == shown(theirs) and len(ours) > 0


def test_texts_without_words_are_no_samples(spark, tmp_path):
    for k, texts in enumerate([[None, "", "  "], []]):
        rows = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
        rows.coalesce(1).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert registry.queries()["speech_reasons"](spark, f"{tmp_path}/{k}").collect() == []
        assert [(r.n, r.samples, r.failed) for r in registry.queries()["speech_summary"](spark, f"{tmp_path}/{k}").collect()] == [(None, 0, 0)] * 2


def test_parts_hold_so_many_bytes():
    texts = ["a" * n for n in (3, 0, 9, 1, 1, 20)] + [None, "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    parts = [b.column("t").to_pylist() for b in T.stretches([batch, batch.slice(0, 0)], "t", 10)]
    assert sum(parts, []) == texts and [len(p) for p in parts] == [2, 2, 1, 1, 2]


def test_groups_that_take_their_hashes_together_draw_as_alone(spark, monkeypatch):
    df = spark.range(9000).select(F.when(F.col("id") < 5000, "a").when(F.col("id") < 7600, "b").when(F.col("id") < 8400, "c").alias("g"), F.col("id").alias("key"), (F.col("id") % 7).alias("num"), F.lit(1).alias("den"))
    alone = {(r.g, r.rep): r for r in stats.replicates(df, ["g"], 5, 3).collect()}
    made, on_blocks = [], stats.on_blocks
    monkeypatch.setattr(stats, "on_blocks", lambda runs, *more: made.append(runs) or on_blocks(runs, *more))
    monkeypatch.setattr(stats, "RUN", 700)
    assert {(r.g, r.rep): r for r in stats.replicates(df, ["g"], 5, 3).collect()} == alone and len(alone) == 20
    assert {len(r.groups) for r in made[0].select("groups").collect()} == {3, 1}
