"""Backends as metrics with a fake model, and results that stay when a rerun fails."""

import json
import os

import numpy as np
import pandas as pd
import pytest

from murmura.__main__ import main
from murmura.sources import audio, backends, results


def fake():
    """A class that the workers get by value, as they can't import this file."""

    class Loud(backends.Backend):
        """Hears a word for each tenth of a second that is loud; a clip that begins with full scale breaks it."""

        def __init__(self, level=0.1, log=None):
            self.level, self.log, self.loaded = level, log, 0

        def describe(self):
            return {"model": "loud", "level": self.level}

        def setup(self):
            self.loaded += 1
            if self.log:
                with open(f"{self.log}/setup-{os.getpid()}", "a") as f:
                    f.write("x")

        def run(self, rows):
            assert self.loaded == 1 and list(rows.columns) == ["sample_id", "rate", "x"]
            out = []
            for x in rows["x"]:
                x = np.asarray(x)
                if x[0] > 0.99:
                    raise RuntimeError("model broke")
                parts = [k for k in range(len(x) // 1600) if np.abs(x[k * 1600 : (k + 1) * 1600]).max() > self.level]
                out.append({"text": " ".join("tick" for _ in parts), "tokens": ["\u2581tick"] * len(parts), "times": [k / 10 for k in parts], "duration": len(x) / 16000})
            if self.log:
                with open(f"{self.log}/batch-{os.getpid()}-{len(os.listdir(self.log))}", "w") as f:
                    f.write(str(len(rows)))
            return out

    return Loud


def clip(parts, first=0.0):
    x = np.concatenate([np.full(1600, 0.5 if p else 0.0) for p in parts])
    x[0] = first
    return audio.wav(x, 16000)


def found(spark, clips):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in clips.items()], "sample_id string, content binary").repartition(1)


def test_backend_by_batches_with_failed_samples_as_rows(spark, tmp_path):
    Loud = fake()  # noqa: N806
    (tmp_path / "log").mkdir()
    clips = {f"s{k}": clip([k % 2, 1, 0, k % 3 == 0]) for k in range(40)} | {"broken": clip([1, 1], 1.0), "torn": b"RIFF"}
    path = str(tmp_path / "asr")
    got = {r.sample_id: r for r in backends.run(Loud(log=str(tmp_path / "log")), found(spark, clips), path).collect()}
    assert len(got) == 42 and got["broken"].error == "model broke" and got["torn"].error == "not a WAV file"
    assert got["s1"].text == "tick tick" and got["s1"].times == [0.0, 0.1] and got["s3"].duration == pytest.approx(0.4) and all(r.error is None for k, r in got.items() if k[1:].isdigit())
    names = os.listdir(tmp_path / "log")
    assert all((tmp_path / "log" / n).read_text() == "x" for n in names if n.startswith("setup")) and any(n.startswith("setup") for n in names)
    facts = results.facts_of(spark, path)
    assert (facts["n_records"], facts["n_errors"], facts["describe"]["level"]) == (42, 2, 0.1)
    before = len(names)
    assert backends.run(Loud(log=str(tmp_path / "log")), found(spark, clips), path).count() == 42 and len(os.listdir(tmp_path / "log")) == before  # nothing ran again
    quiet = backends.run(Loud(level=0.9), found(spark, clips), path)
    assert {r.text for r in quiet.collect() if r.error is None} == {""} and results.facts_of(spark, path)["describe"]["level"] == 0.9
    assert backends.run(Loud(level=0.9), found(spark, {**clips, "s1": clip([0, 0, 0])}), path).where("sample_id = 's1'").first().duration == pytest.approx(0.3)


def test_registered_names(spark):
    Loud = fake()  # noqa: N806
    backends.register("loud")(Loud)
    assert backends.create("asr", "loud", level=0.3).describe() == {"model": "loud", "level": 0.3}
    with pytest.raises(ValueError, match="no asr backend"):
        backends.create("asr", "quiet")
    with pytest.raises(ValueError, match="no pmos backend"):
        backends.create("pmos", "loud")
    assert isinstance(backends.create("asr", "murmura.sources.backends:Backend"), backends.Backend)


def test_a_failed_rerun_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    class Length(results.Metric):
        name, schema = "length", "n long"

        def batch(self, rows):
            return [{"n": len(t)} for t in rows["text"]]

    samples = spark.createDataFrame([("a", "xyz"), ("b", "x")], "sample_id string, text string")
    path = str(tmp_path / "m" / "length")
    assert results.run(Length(), samples, path, "one").count() == 2
    dying = samples.selectExpr("sample_id", "CASE WHEN sample_id = 'b' THEN raise_error('lost') ELSE text END AS text")
    with pytest.raises(Exception, match="lost"):
        results.run(Length(), dying, path, "two")
    assert {(r.sample_id, r.n) for r in spark.read.parquet(f"{path}/rows").collect()} == {("a", 3), ("b", 1)} and results.facts_of(spark, path)["inputs"] == "one"
    assert os.listdir(tmp_path / "m") == ["length"]
    monkeypatch.setattr(results, "digest", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError, match="disk"):
        results.run(Length(), samples.limit(1), path, "three")
    monkeypatch.undo()
    assert results.run(Length(), samples.limit(0), path, "one").count() == 2 and os.listdir(tmp_path / "m") == ["length"]
    os.rename(path, results.aside(path))  # as if the second rename had not come
    assert results.run(Length(), samples.limit(0), path, "one").count() == 2 and os.listdir(tmp_path / "m") == ["length"]


def test_batches_that_fail_are_halved():
    class Odd(results.Metric):
        calls = 0

        def batch(self, rows):
            self.calls += 1
            if (rows["v"] == 13).any():
                raise ValueError("thirteen")
            return [{"n": v} for v in rows["v"]]

    metric = Odd()
    got = results.settled(metric, pd.DataFrame({"v": range(64)}))
    assert [x.get("n") for x in got] == [None if v == 13 else v for v in range(64)] and got[13]["error"] == "thirteen" and metric.calls == 13
    metric.batch = lambda rows: []
    assert all("results of" in x["error"] for x in results.settled(metric, pd.DataFrame({"v": [1, 2]})))


def test_run_with_a_backend(spark, tmp_path):
    backends.register("loud-run")(fake())
    (tmp_path / "c" / "train" / "ann").mkdir(parents=True)
    (tmp_path / "made").mkdir()
    (tmp_path / "c" / "train" / "ann" / "ann.json").write_text(json.dumps([{"audio": f"{k}.wav", "text": "tick [hum] tick", "language": "xx"} for k in range(3)]))
    for k in range(3):
        (tmp_path / "made" / f"ann_{k}.wav").write_bytes(clip([1, 0, 0, 1]))
    at = lambda x: str(tmp_path / x)
    assert main(["manifest", "--root", at("c"), "--split", "train", "--out", at("m")], spark) == 0
    spark.createDataFrame([(f"ann_{k}", 1, "hum", 0.9) for k in range(3)], "sample_id string, gap long, type string, prob double").write.parquet(at("probs"))
    (tmp_path / "t.json").write_text(json.dumps({"hum": 0.5}))
    tables = ["--manifest", at("m"), "--probs", at("probs"), "--thresholds", at("t.json"), "--out", at("out")]
    with pytest.raises(SystemExit):
        main(["run", *tables], spark)
    assert main(["run", *tables, "--backend", "loud-run", "--audio", at("made"), "--settings", '{"level": 0.2}'], spark) == 0
    one = spark.read.json(at("out/summary")).first()
    assert (one["nvpa"], one["wer"]) == (1.0, 0.0)
