"""Files written and read: corpora, manifests, results, sheets."""

import json

import pytest
from pyspark.sql import functions as F

from murmura.operators import manifest as M
from murmura.operators import ratings as R
from murmura.sources import corpus, manifest, results, sheets


@pytest.fixture
def root(tmp_path):
    for speaker, lists in {"ann": {"ann.json": [{"audio": "b.wav", "text": "hi [sigh]", "language": "en"}, {"audio": "a.wav", "text": "x", "mood": "calm"}], "other.json": []}, "bo": {"any.json": [{"audio": "c.wav", "text": "y"}, {"audio": "d.wav"}]}, "cy": {"1.json": [], "2.json": []}, "di": {"di.json": "no list"}}.items():
        folder = tmp_path / "corpus" / "train" / speaker
        folder.mkdir(parents=True)
        for name, rows in lists.items():
            (folder / name).write_text(json.dumps(rows), "utf-8")
    for name in ("ann/b.wav", "ann/z.flac", "bo/c.wav"):
        (tmp_path / "corpus" / "train" / name).write_bytes(b"RIFF")
    return str(tmp_path / "corpus")


def test_scan(spark, root):
    rows, problems = corpus.scan(spark, root, "train")
    assert {(r.speaker, r.audio, r.tagged, r.lang, r.more) for r in rows.collect()} == {("ann", "train/ann/b.wav", "hi [sigh]", "en", ""), ("ann", "train/ann/a.wav", "x", None, "mood"), ("bo", "train/bo/c.wav", "y", None, "")}
    assert {(r.speaker, r.problem) for r in problems.collect()} == {("bo", "no audio or no text"), ("cy", "several lists, none named like the folder"), ("di", "not a list of utterances")}
    with pytest.raises(ValueError, match="bo: no audio"):
        corpus.strict(spark, root, "train")
    there = corpus.files(spark, root)
    assert {r.path for r in corpus.unlisted(rows, there).collect()} == {"train/ann/z.flac"}


def test_manifest_from_scan_to_file(spark, root, tmp_path):
    rows, _ = corpus.scan(spark, root, "train")
    files = spark.createDataFrame([("out/ann_b.flac",), ("out/ann_b.wav",), ("out/bo_c.flac",), ("train/ann/a.wav",)], "path string")
    samples = M.built(rows, "A", files, most=2)
    got = {r.sample_id: r for r in samples.collect()}
    assert set(got) == {"ann_a", "ann_b", "bo_c"}
    assert got["ann_b"].refs == ["train/ann/a.wav"] and got["bo_c"].refs == [] and got["ann_b"].generated == "out/ann_b.wav" and got["bo_c"].generated == "out/bo_c.flac"
    assert {r.sample_id: r.missing for r in M.missing_inputs(samples, files).collect()} == {"ann_a": "missing_generated_audio", "ann_b": None, "bo_c": "missing_reference_audio"}
    assert M.report(samples, files).first().asDict() == {"samples": 3, "speakers": 2, "missing_ground_truth": 2, "missing_generated": 1, "speakers_without_references": 1, "errors": 0}
    assert [r.sample_id for r in M.limited(samples, 2).collect()] == ["ann_a", "ann_b"]
    path = str(tmp_path / "manifest")
    manifest.save(samples, path, "A", "corpus", "train")
    header, again = manifest.load(spark, path)
    assert header["track"] == "A" and again.orderBy("sample_id").select("sample_id", "words", "events", "refs").collect() == samples.orderBy("sample_id").select("sample_id", "words", "events", "refs").collect()
    assert M.validated(again, "A").count() == 0
    assert {(r.sample_id, r.problem) for r in M.validated(again.withColumn("words", F.array(F.lit("hi"))), "B").collect()} == {("ann_a", "words differ from the text"), ("bo_c", "words differ from the text"), ("bo_c", "no references")}
    assert {r.problem for r in M.validated(again.union(again), "A").collect()} == {"duplicate id"}
    with pytest.raises(ValueError, match="track"):
        M.validated(again, "C")
    spark.createDataFrame([('{"sample_id": "x"}',)], "value string").write.text(str(tmp_path / "headless"))
    with pytest.raises(ValueError, match="header"):
        manifest.load(spark, str(tmp_path / "headless"))


def test_references_of_track_b(spark, root, tmp_path):
    (tmp_path / "refs.json").write_text('{"ann_a": ["p", "q"]}')
    rows, _ = corpus.scan(spark, root, "train")
    refs = manifest.references(spark, str(tmp_path / "refs.json"))
    made = M.built(rows, "B", spark.createDataFrame([], "path string"), references=refs, speakers=["ann"])
    assert {r.sample_id: r.refs for r in made.collect()} == {"ann_a": ["p", "q"], "ann_b": []}
    with pytest.raises(ValueError, match="references"):
        M.built(rows, "B", rows.select("audio"))


def test_paths(spark):
    df = spark.createDataFrame([("/r/", "a/b.wav"), ("/r", "/abs.wav"), ("/r", None)], "root string, path string")
    assert [r[0] for r in df.select(M.resolved(F.col("root"), F.col("path"))).collect()] == ["/r/a/b.wav", "/abs.wav", None]


def metrics():
    """Classes that the workers get by value, as they can't import this file."""

    class Length(results.Metric):
        name = "length"
        schema = "n long"
        config = {"unit": "characters"}  # noqa: RUF012

        def setup(self):
            self.ready = True

        def compute(self, row):
            if not self.ready or row["text"] == "bad":
                raise RuntimeError("cannot read")
            return {"n": len(row["text"]), "more": 1}

    class Reserved(Length):
        schema = "error string"

    return Length, Reserved


def test_results_are_reused_while_nothing_changed(spark, tmp_path):
    Length, Reserved = metrics()  # noqa: N806
    samples = spark.createDataFrame([("a", "xyz", None), ("b", "bad", None), ("c", "x", "missing_generated_audio")], "sample_id string, text string, missing string")
    path = str(tmp_path / "length")
    first = {r.sample_id: (r.n, r.error) for r in results.run(Length(), samples, path, "one").collect()}
    assert first == {"a": (3, None), "b": (None, "cannot read"), "c": (None, "missing_generated_audio")}
    facts = results.facts_of(spark, path)
    assert (facts["n_records"], facts["n_errors"]) == (3, 2)
    assert results.run(Length(), samples.limit(0), path, "one").count() == 3
    assert results.run(Length(), samples.limit(1), path, "two").count() == 1
    samples.select("sample_id", F.lit(9).cast("long").alias("n"), F.lit(None).cast("string").alias("error")).write.mode("overwrite").parquet(f"{path}/rows")
    assert results.run(Length(), samples, path, "two").where("n = 9").count() == 0  # rows that aren't the recorded ones
    with pytest.raises(ValueError, match="reserved"):
        results.computed(Reserved(), samples)


def test_sheets(spark, tmp_path):
    (tmp_path / "sheets").mkdir()
    (tmp_path / "sheets" / "rita.csv").write_text('﻿item_id,SN,Q,NV_naturalness,NV_placement\ni1,"4,5",3,,\ni2,7,x,2,\n ,1,1,1,1\n', "utf-8")
    (tmp_path / "sheets" / "sam.csv").write_text("item_id,SN,Q\ni1,2,2\n", "utf-8")
    typed = sheets.read(spark, str(tmp_path / "sheets" / "rita.csv"))
    rows = {(r.rater, r.item): (r.sn, r.q, r.naturalness, r.placement) for r in R.cleaned(typed).collect()}
    assert rows == {("rita", "i1"): (4.5, 3.0, None, None), ("rita", "i2"): (None, None, 2.0, None)}
    assert {(r.item, r.field, r.typed) for r in R.problems(typed).collect()} == {("i2", "sn", "7"), ("i2", "q", "x")}
    assert sheets.read(spark, str(tmp_path / "sheets" / "sam.csv")).first().placement is None


def test_package_files(spark, tmp_path):
    items = spark.createDataFrame([("item_0001", "model", "s1", "a"), ("item_0002", "anchor_gt", "s2", "b")], "item string, kind string, sample_id string, speaker string")
    sheets.write_package(items, str(tmp_path / "p"))
    assert sheets.read_key(spark, str(tmp_path / "p")).count() == 2
    assert [r.item for r in sheets.read(spark, str(tmp_path / "p" / "sheet")).orderBy("item").collect()] == ["item_0001", "item_0002"]


def test_small_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], float("nan")), (2, None, 3.0)], "k int, a array<int>, x double")
    sheets.write_csv(df, str(tmp_path / "csv"))
    assert {r.a for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"1|2", None}
    sheets.write_json(df, str(tmp_path / "json"))
    assert {r.x for r in spark.read.json(str(tmp_path / "json")).collect()} == {None, 3.0}
