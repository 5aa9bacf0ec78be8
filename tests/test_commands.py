"""The commands from end to end on a small corpus, settings, and detectors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from murmura import config
from murmura.__main__ import main
from murmura.operators import detector


@pytest.fixture
def made(spark, tmp_path):
    rng = random.Random(1)
    for s in ("ann", "bo", "cy"):
        folder = tmp_path / "c" / "train" / s
        folder.mkdir(parents=True)
        rows = []
        for k in range(6):
            words = [rng.choice("uvwxyz") for _ in range(5)]
            words.insert(rng.randrange(6), rng.choice(["[hum]", "[hum]", "[sigh]"]))
            rows.append({"audio": f"{k}.wav", "text": " ".join(words), "language": "xx"})
            (folder / f"{k}.wav").write_bytes(b"RIFF")
        (folder / f"{s}.json").write_text(json.dumps(rows))
    (tmp_path / "thresholds.json").write_text(json.dumps({"hum": 0.5, "sigh": 0.5}))
    return tmp_path


def test_commands(spark, made, capsys):
    at = lambda x: str(made / x)
    assert main(["manifest", "--root", at("c"), "--split", "train", "--out", at("m")], spark) == 0
    assert main(["validate", "--manifest", at("m")], spark) == 0
    from murmura.sources import manifest

    header, samples = manifest.load(spark, at("m"))
    assert header["split"] == "train" and samples.count() == 18
    spoken = samples.select("sample_id", F.transform("words", lambda w: F.concat(F.lit("▁"), w)).alias("tokens"), F.transform("words", lambda w, i: 0.5 * i + 0.1).alias("times"), F.lit(3.0).alias("duration"), F.array_join("words", " ").alias("text"), F.lit(None).cast("string").alias("error"))
    spoken.write.parquet(at("asr"))
    events = samples.select("sample_id", F.inline("events"))
    events.select("sample_id", F.col("gap").cast("long").alias("gap"), "type", F.lit(0.9).alias("prob")).write.parquet(at("probs"))
    values = samples.select("sample_id", F.lit(3.0).alias("value"))
    values.write.parquet(at("pmos"))
    values.withColumn("value", F.lit(0.5)).write.parquet(at("ss"))
    tables = ["--manifest", at("m"), "--asr", at("asr"), "--probs", at("probs"), "--thresholds", at("thresholds.json")]
    capsys.readouterr()
    assert main(["run", *tables, "--out", at("out"), "--pmos", at("pmos"), "--ss", at("ss")], spark) == 0
    text = capsys.readouterr().out
    one = spark.read.json(at("out/summary")).first()
    assert (one["nvpa"], one["wer"], one["pmos"], one["ss"]) == (1.0, 0.0, 3.0, 0.5) and one["auto"] == pytest.approx(0.3 + 0.15 + 0.075 + 0.05)
    assert "missing_final" in text
    assert main(["nvpa-sweep", *tables, "--out", at("sweep"), "--reps", "2", "--scales", "1.0", "--tolerances", "0", "0:1"], spark) == 0
    assert {r.accuracy for r in spark.read.json(at("sweep")).where("type IS NULL").collect()} == {1.0}
    (made / "own.json").write_text(json.dumps({"human": {"subset_size": 6, "n_gt_anchors": 2, "n_degraded_anchors": 2}}))
    assert main(["--config", at("own.json"), "human-subset", "--manifest", at("m"), "--out", at("h")], spark) == 0
    key = spark.read.json(at("h/package/key")).collect()
    assert len(key) == 10
    (made / "sheets").mkdir()
    for rater in ("rita", "sam"):
        lines = [f"{r['item']},{ {'anchor_gt': 5, 'anchor_degraded': 1, 'model': 4}[r['kind']] },4,3,2" for r in key]
        (made / "sheets" / f"{rater}.csv").write_text("item_id,SN,Q,NV_naturalness,NV_placement\n" + "\n".join(lines) + "\nitem_9999,3,3,3,3\n")
    assert main(["human-import", "--sheets", at("sheets"), "--package", at("h/package"), "--out", at("rated")], spark) == 0
    assert spark.read.parquet(at("rated")).count() == 6 and "item_9999" in capsys.readouterr().out
    assert main(["summary", "--manifest", at("m"), "--out", at("out"), "--pmos", at("pmos"), "--ss", at("ss"), "--human", at("rated")], spark) == 0
    one = spark.read.json(at("out/summary")).first()
    assert one["final"] == pytest.approx(0.575 + 0.15 * 0.75 * 2) and one["n_rated"] == 6
    events.select("sample_id", "gap", "type").groupBy("sample_id", "gap").agg(F.first("type").alias("t")).write.parquet(at("gold"))
    gaps = samples.select("sample_id", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("gap")).join(spark.read.parquet(at("gold")), ["sample_id", "gap"], "left")
    gaps.select("sample_id", "gap", F.array(F.coalesce((F.col("t") == "hum").cast("double"), F.lit(0.0)), F.rand(1)).alias("features")).write.parquet(at("features"))
    assert main(["train-detector", "--manifest", at("m"), "--asr", at("asr"), "--features", at("features"), "--out", at("d"), "--types", "hum", "cough", "--folds", "2", "--iterations", "2"], spark) == 0
    found = detector.load(at("d"), spark)
    assert found["cough"]["threshold"] == 1.01 and found["cough"]["model"] is None and found["hum"]["recall"] == 1.0 and found["hum"]["auc"] == 1.0
    probs = detector.predicted(found, spark.read.parquet(at("features")))
    high = {(r.sample_id, r.gap) for r in probs.where(F.col("prob") >= found["hum"]["threshold"] - 1e-4).collect()}
    assert high == {(r.sample_id, r.gap) for r in spark.read.parquet(at("gold")).where("t = 'hum'").collect()}
    assert detector.differing({"hum": found["hum"]["threshold"], "x": 0.5}, found) == ["cough", "x"]
    manifest.save(samples, at("dev"), "A", "c", "dev")
    with pytest.raises(SystemExit, match="dev"):
        main(["train-detector", "--manifest", at("dev"), "--asr", at("asr"), "--features", at("features"), "--out", at("d"), "--types", "hum"], spark)


def test_settings(tmp_path):
    assert config.settings(preset="late")["nvpa"] == config.DEFAULTS["nvpa"] | {"tolerance": "0:1", "threshold_scale": 0.75}
    for bad in ({"track": "C"}, {"nvpa": {"other": 1}}, {"other": 1}, {"bootstrap": {"alpha": 2}}):
        with pytest.raises(ValueError, match=r"unknown|none of|range"):
            config.settings(bad)
    (tmp_path / "c.json").write_text('{"human": {"seed": 4}}')
    assert config.load(str(tmp_path / "c.json"))["human"]["seed"] == 4 and config.load(None) == config.DEFAULTS


def test_threshold_is_the_best(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(300)]
    got = detector.threshold_of(spark.createDataFrame(rows, "p double, y int"), "y")
    f1 = lambda t: 2 * sum(y for p, y in rows if p >= t) / (sum(p >= t for p, _ in rows) + sum(y for _, y in rows))
    assert got["threshold"] == max({p for p, _ in rows}, key=lambda t: (f1(t), t))
    wins = [(p > q) + (p == q) / 2 for p, y in rows if y for q, z in rows if not z]
    assert got["auc"] == pytest.approx(sum(wins) / len(wins))
