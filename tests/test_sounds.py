"""Audio: headers and samples, resampling, frames and windows against plain numpy; the file sink, degraded copies, packages, folds."""

import json
import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.__main__ import main
from murmura.operators import acoustics as A
from murmura.operators import detector
from murmura.sources import audio, sheets, sink

RNG = np.random.default_rng(12)


def riff(form, data, extra=b"", size=None):
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data) if size is None else size) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def form(kind, channels, rate, bits):
    return struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)


def table(spark, found):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in found.items()], "clip string, content binary").repartition(3)


def decoded(spark, found, **more):
    return {r.clip: r for r in audio.decoded(table(spark, found), **more).collect()}


def test_formats(spark):
    x = np.array([0.0, 0.5, -0.25, -1.0])
    wide = (x * 2**23).astype("<i4")
    found = {
        "16": riff(form(1, 1, 8000, 16), (x * 2**15).astype("<i2").tobytes()),
        "8": riff(form(1, 1, 8000, 8), (x * 128 + 128).astype("u1").tobytes()),
        "24": riff(form(1, 1, 8000, 24), b"".join(struct.pack("<i", v)[:3] for v in wide.tolist())),
        "32": riff(form(1, 1, 8000, 32), (x * 2**31).astype("<i4").tobytes()),
        "f32": riff(form(3, 1, 8000, 32), x.astype("<f4").tobytes()),
        "f64": riff(form(3, 1, 8000, 64), x.astype("<f8").tobytes()),
        "extended": riff(form(0xFFFE, 1, 8000, 16) + struct.pack("<HHIH", 22, 16, 4, 1) + b"\0" * 14, (x * 2**15).astype("<i2").tobytes()),
        "chunks": riff(form(1, 1, 8000, 16), (x * 2**15).astype("<i2").tobytes(), extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"),
    }
    for clip, r in decoded(spark, found).items():
        assert r.error is None and np.allclose(r.x, x, atol=1e-6) and (r.total, r.n, r.rate) == (4, 4, 8000), clip
    pair = decoded(spark, {"two": riff(form(1, 2, 44100, 16), np.array([[100, 300], [-50, 50]], "<i2").tobytes())})["two"]
    assert np.allclose(np.array(pair.x) * 2**15, [200, 0])
    probe = {r.clip: r for r in audio.probed(table(spark, found | {"two": riff(form(1, 2, 44100, 16), b"\0" * 8)})).collect()}
    assert (probe["two"].frames, probe["two"].channels, probe["two"].bits, probe["24"].bits) == (2, 2, 16, 24) and probe["two"].seconds == pytest.approx(2 / 44100)


def test_what_cannot_be_read_is_a_row_with_an_error(spark):
    good = riff(form(1, 1, 8000, 16), b"\1\0" * 40)
    bad = {
        "none": None, "empty": b"", "text": b"hello, this is no sound", "torn": good[:-7], "header": good[:20], "silent": riff(form(1, 1, 8000, 16), b""),
        "nan": riff(form(3, 1, 8000, 32), np.array([1, np.nan], "<f4").tobytes()), "law": riff(form(7, 1, 8000, 8), b"abc"), "still": riff(form(1, 1, 0, 16), b"ab"), "formless": b"RIFF\0\0\0\0WAVEdata\4\0\0\0abcd", "odd": riff(form(1, 1, 8000, 12), b"abc"),
    }
    got = decoded(spark, bad | {"good": good})
    assert {k for k, r in got.items() if r.error is None} == {"good"} and all(r.x is None for k, r in got.items() if k != "good")
    probe = {r.clip: r.error for r in audio.probed(table(spark, bad | {"good": good})).collect()}
    assert {k for k, e in probe.items() if e is None} == {"good", "nan"}
    assert audio.decoded(table(spark, {"good": good}).limit(0)).collect() == []
    assert A.frames(A.blocks_for_frames(table(spark, bad))).collect() == []


def convolved(x, up, down):
    """Stretch with zeros, filter, take every down-th: the definition, over the whole clip."""
    half = 10 * max(up, down)
    at = np.arange(-half, half + 1)
    h = np.sinc(at / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, h)[half : half + len(wide)][::down]


@pytest.mark.parametrize("rate,wanted", [(24_000, 16_000), (8000, 16_000), (44_100, 16_000), (16_000, 16_000), (48_000, 16_000)])
@pytest.mark.parametrize("block", [None, 500, 16_000])
def test_resampling_in_blocks_is_the_whole_convolution(spark, rate, wanted, block):
    clips = {f"c{n}": audio.wav(RNG.uniform(-1, 1, n), rate) for n in (1, 7, 999, 9000)}
    rows = A.resampled(audio.decoded(table(spark, clips), wanted, block), wanted).orderBy("clip", "at").collect()
    up, down = audio.steps(rate, wanted)
    for clip, raw in clips.items():
        x = np.frombuffer(raw[44:], "<i2") / 2**15
        got = np.concatenate([r.x for r in rows if r.clip == clip])
        want = x if rate == wanted else convolved(x, up, down)
        assert len(got) == math.ceil(len(x) * up / down) and np.allclose(got, want[: len(got)], atol=1e-5), clip
        assert {r.total for r in rows if r.clip == clip} == {len(got)}


def plain_frames(x):
    """Every feature of every frame, one frame at a time, with a transform by its definition."""
    x = np.pad(x, (0, max(0, 400 - len(x))))
    hz, out = np.arange(257) * 31.25, []
    basis = np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(400)) / 512)
    for k in range(0, len(x) - 399, 160):
        own = x[k : k + 400]
        v = own * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 399))
        power = np.abs(basis @ v) ** 2
        total = power.sum()
        e = 10 * np.log10(total + 1e-10)
        edges = [0, 250, 500, 1000, 2000, 3000, 4000, 5500, 8000]
        band = [10 * np.log10(power[(hz >= a) & (hz < b)].sum() + 1e-10) - e for a, b in zip(edges, edges[1:])]
        p = power[hz >= 100] + 1e-10
        echo = [np.dot(v[: 400 - lag], v[lag:]) for lag in range(268)]
        out.append([e, *band, math.exp(np.log(p).mean()) / p.mean(), (power * hz).sum() / (total + 1e-10), np.mean((own[1:] < 0) != (own[:-1] < 0)), power[hz >= 4000].sum() / (total + 1e-10), power[hz < 500].sum() / (total + 1e-10), max(echo[40:]) / (echo[0] + 1e-10)])
    return np.array(out)


def sound(n, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / 16_000
    return np.clip(0.3 * np.sin(2 * np.pi * 220 * t) * (1 + np.sin(2 * np.pi * 5 * t)) / 2 + 0.05 * rng.standard_normal(n), -1, 1)


def test_frames_equal_the_definition(spark):
    clips = {f"c{n}": audio.wav(sound(n, n), 16_000) for n in (1, 399, 400, 560, 1600, 1601, 1839, 1840, 7000)}
    own = A.frames(A.resampled(audio.decoded(table(spark, clips), 16_000, 1600, 240), 16_000), 1600).orderBy("clip", "frame").collect()
    for clip, raw in clips.items():
        want = plain_frames((np.frombuffer(raw[44:], "<i2") / 2**15).astype(np.float32).astype(np.float64))
        got = [r for r in own if r.clip == clip]
        assert [r.frame for r in got] == list(range(len(want))), clip
        values = np.array([[r.e, *r.band, r.flat, r.cent, r.zcr, r.hf, r.lf, r.voic] for r in got])
        assert np.allclose(values, want, rtol=1e-5, atol=1e-5), clip


def plain_window(f, t0, t1):
    """The 38 features of one window from plain_frames."""
    lo, hi = max(0, math.ceil((t0 * 16_000 - 200) / 160)), min(len(f), math.floor((t1 * 16_000 - 200) / 160) + 1)
    if hi <= lo:
        lo = int(min(max(round(((t0 + t1) / 2 * 16_000 - 200) / 160), 0), len(f) - 1))
        hi = lo + 1
    w, e = f[lo:hi], f[lo:hi, 0]
    hz = ratio = 0.0
    if len(e) >= 16:
        env = 10 ** (e / 20)
        p = np.abs(np.fft.rfft((env - env.mean()) * np.hanning(len(env)))) ** 2
        at = np.fft.rfftfreq(len(env), 0.01)
        near = [k for k in range(len(at)) if 2 <= at[k] <= 10]
        best = max(near, key=lambda k: p[k])
        hz, ratio = at[best], p[best] / (sum(p[k] for k in range(len(at)) if 0.5 <= at[k] <= 20) + 1e-10)
    mean, std = w.mean(0), w.std(0)
    return [t1 - t0, e.mean(), e.std(), e.min(), e.max(), np.percentile(e, 10), np.percentile(e, 90), e.mean() - np.median(f[:, 0]), e.max() - np.percentile(f[:, 0], 90), *mean[1:9], *std[1:9],
            mean[9], std[9], mean[10], std[10], mean[11], std[11], mean[12], mean[13], mean[14], w[:, 14].max(), hz, ratio, np.mean(e < np.median(f[:, 0]) - 25)]


def test_windows_over_frames(spark):
    x = {"a": sound(16_000, 1), "b": sound(3000, 2), "c": sound(100, 3)}
    own = A.frames(A.blocks_for_frames(table(spark, {k: audio.wav(v, 16_000) for k, v in x.items()}))).cache()
    rng = np.random.default_rng(6)
    asked = [(c, g, float(t), float(t + d)) for c in x for g, (t, d) in enumerate(zip(rng.uniform(0, len(x[c]) / 16_000, 12), rng.choice([0.001, 0.02, 0.1, 0.4], 12)))] + [("a", 50, None, None), ("gone", 1, 0.0, 1.0), ("b", 60, 5.0, 6.0)]
    got = {(r.clip, r.gap): r.features for r in A.window_features(spark.createDataFrame(asked, "clip string, gap long, t0 double, t1 double"), own).collect()}
    assert set(got) == {(c, g) for c, g, t, _ in asked if t is not None and c in x} and len(A.NAMES) == 38
    plain = {c: plain_frames((np.rint(v * 32767) / 2**15).astype(np.float32).astype(np.float64)) for c, v in x.items()}
    for c, g, t0, t1 in asked:
        if (c, g) in got:
            assert np.allclose(got[c, g], plain_window(plain[c], t0, t1), rtol=1e-3, atol=1e-3), (c, g)


def listing(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_files_are_there_wholly_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"a/{k}.bin" if k % 2 else f"{k}.bin", bytearray(b"x" * k)) for k in range(20)], "name string, content binary").repartition(4)
    sink.write(rows, path)
    assert len(listing(path)) == 20 and (tmp_path / "out" / "a" / "7.bin").read_bytes() == b"x" * 7 and not [d for d in os.listdir(path) if d.startswith("_staged")]
    broken = rows.withColumn("content", F.when(F.col("name") == "12.bin", F.raise_error("boom").cast("binary")).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="boom"):
        sink.write(broken, path)
    with pytest.raises(Exception, match="twice"):
        sink.write(rows.union(rows.limit(1)), path)
    for name in ("../up.bin", "/root.bin", "", None):
        with pytest.raises(Exception, match="not a name"):
            sink.write(spark.createDataFrame([(name, bytearray(b"x"))], rows.schema), path)
    assert len(listing(path)) == 20 and (tmp_path / "out" / "a" / "7.bin").read_bytes() == b"x" * 7 and not [d for d in os.listdir(path) if d.startswith("_staged")]
    sink.write(spark.createDataFrame([("a/7.bin", bytearray(b"new"))], rows.schema), path)
    assert len(listing(path)) == 20 and (tmp_path / "out" / "a" / "7.bin").read_bytes() == b"new"
    sink.write(rows.where("name = '4.bin'"), path, overwrite=True)
    assert listing(path) == ["4.bin"]


def test_noise_has_the_ratio_and_repeats(spark):
    clips = [(f"c{k}", 16_000, sound(20_000, k).astype(np.float32).tolist(), k % 2 == 0) for k in range(4)] + [("silent", 8000, [0.0] * 500, True), ("empty", 8000, [], True)]
    rows = spark.createDataFrame(clips, "name string, rate int, x array<float>, hit boolean").repartition(3)
    a, b = ({r.name_: np.array(r.x) for r in A.degraded(rows, 5.0, seed, F.col("hit")).withColumnRenamed("name", "name_").collect()} for seed in (1, 1))
    for name, _, x, hit in clips:
        assert np.array_equal(a[name], b[name])
        if hit and name.startswith("c"):
            noise = a[name] - np.array(x)
            assert abs(10 * math.log10(np.mean(np.square(x)) / np.mean(noise**2)) - 5.0) < 0.1 and abs(noise.mean()) < 0.01
        elif not hit:
            assert np.allclose(a[name], x)
    draws = A.normal(3, -5, 100_000)
    assert abs(draws.std() - 1) < 0.01 and abs(np.mean(draws**4) - 3) < 0.1 and not np.array_equal(draws[:50], A.normal(4, -5, 50))
    assert abs(np.corrcoef(draws[:-1], draws[1:])[0, 1]) < 0.02


def test_package_with_sounds(spark, tmp_path):
    for kind in ("made", "real"):
        (tmp_path / kind).mkdir()
        for k in range(12):
            if (kind, k) != ("made", 3):
                (tmp_path / kind / f"s{k}.wav").write_bytes(b"broken" if (kind, k) == ("made", 4) else audio.wav(sound(2000, k) * (1 if kind == "made" else 0.5), 16_000))
    samples = spark.createDataFrame([(f"s{k}", f"p{k % 3}", f"text {k}, [hum]") for k in range(12)], "sample_id string, speaker string, text string")
    chosen = samples.where("sample_id IN ('s0', 's1', 's2', 's3', 's4')").select("sample_id", "speaker")
    files = [audio.of_samples(spark, str(tmp_path / k)) for k in ("made", "real")]
    one = sheets.export(samples, chosen, *files, str(tmp_path / "out"), 2, 2, 5.0, 1).first()
    assert (one["items"], one["skipped"]) == (7, 2)
    key = {r.item: r for r in sheets.read_key(spark, str(tmp_path / "out")).collect()}
    assert sorted(os.listdir(tmp_path / "out" / "audio")) == sorted(f"{i}.wav" for i in key)
    sheet = spark.read.option("header", True).csv(str(tmp_path / "out" / "sheet")).collect()
    assert {r.audio_file for r in sheet} == {f"audio/{i}.wav" for i in key} and {r.transcript for r in sheet} <= {f"text {k}, [hum]" for k in range(12)}
    for item, r in key.items():
        raw = (tmp_path / "out" / "audio" / f"{item}.wav").read_bytes()
        plain = audio.wav(sound(2000, int(r.sample_id[1:])) * (1 if r.kind == "model" else 0.5), 16_000)
        difference = np.abs(np.frombuffer(raw[44:], "<i2").astype(int) - np.frombuffer(plain[44:], "<i2"))
        assert (difference.max() > 100) if r.kind == "anchor_degraded" else (difference.max() <= 1), r
        assert r.sample_id not in ("s3", "s4") if r.kind == "model" else r.sample_id not in ("s0", "s1", "s2", "s3", "s4")


def test_folds_are_whole_groups_of_like_size(spark):
    rng = np.random.default_rng(3)
    rows = [(None if k == 0 else f"p{k:02d}",) for k, n in enumerate(rng.integers(1, 60, 23).tolist()) for _ in range(n)]
    got = detector.group_folds(spark.createDataFrame(rows, "speaker string"), "speaker", 4).collect()
    assert len(got) == 23 and sum(r.n for r in got) == len(rows)
    loads = [0] * 4
    for r in sorted(got, key=lambda r: (-r.n, r.speaker is None, r.speaker)):
        assert r.fold == loads.index(min(loads))
        loads[r.fold] += r.n
    assert max(loads) - min(loads) <= max(r.n for r in got)
    assert {r.fold for r in detector.group_folds(spark.createDataFrame([("a",), ("b",)], "speaker string"), "speaker", 5).collect()} == {0, 1}


def test_detector_on_features_of_the_library(spark, tmp_path):
    """From a corpus, its recognition and WAV files: gaps that hold a burst of noise are told from silent ones, for speakers that weren't learned from."""
    rng, asr, bursts = np.random.default_rng(5), [], set()
    (tmp_path / "made").mkdir()
    for s in ("ann", "bo", "cy"):
        (tmp_path / "c" / "train" / s).mkdir(parents=True)
        rows = []
        for k in range(6):
            gap = int(rng.integers(0, 6))
            words = [f"w{j}" for j in range(5)]
            rows.append({"audio": f"{k}.wav", "text": " ".join([*words[:gap], "[hum]", *words[gap:]]), "language": "xx"})
            (tmp_path / "c" / "train" / s / f"{k}.wav").write_bytes(b"RIFF")
            x = 0.001 * rng.standard_normal(43_200)
            times = [0.3 + 0.45 * j for j in range(5)]
            centre = int(16_000 * (0.45 * gap + 0.07))
            x[centre : centre + 2400] += 0.3 * rng.standard_normal(len(x[centre : centre + 2400]))
            (tmp_path / "made" / f"{s}_{k}.wav").write_bytes(audio.wav(np.repeat(x, 2)[: 2 * len(x)], 32_000) if k == 0 else audio.wav(x, 16_000))
            asr.append((f"{s}_{k}", [f"▁{w}" for w in words], times, 2.7, " ".join(words), None))
            bursts.add((f"{s}_{k}", gap))
        (tmp_path / "c" / "train" / s / f"{s}.json").write_text(json.dumps(rows))
    at = lambda x: str(tmp_path / x)
    spark.createDataFrame(asr, "sample_id string, tokens array<string>, times array<double>, duration double, text string, error string").write.parquet(at("asr"))
    assert main(["manifest", "--root", at("c"), "--split", "train", "--out", at("m")], spark) == 0
    assert main(["train-detector", "--manifest", at("m"), "--asr", at("asr"), "--audio", at("made"), "--out", at("d"), "--types", "hum", "--folds", "3", "--iterations", "3"], spark) == 0
    features = spark.read.parquet(at("d/features"))
    assert features.count() > 60 and {len(r.features) for r in features.select("features").collect()} == {38}
    found = detector.load(at("d"), spark)
    assert found["hum"]["n_pos"] == spark.read.parquet(at("d/windows")).where("hum = 1").count() >= 15 and found["hum"]["auc"] > 0.85
    assert all(r.prob == round(r.prob, 4) for r in detector.predicted(found, features).collect())
