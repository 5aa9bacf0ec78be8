"""From samples to features: resampling by a polyphase filter, frames with their spectra, windows over frames, degraded copies.

Blocks are what sources.audio gives. Every step works on rows that hold what they need, so a long clip is many tasks' work: a
block brings the neighbouring samples that its filter or last frames reach into, and windows meet frames by their number.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from murmura.sources import audio
from murmura.storage import kept

#: Fixed values of the features: rate, samples of a frame, samples between frames, length of the transform, edges of the bands in Hz.
RATE, FRAME, HOP, TRANSFORM = 16_000, 400, 160, 512
BANDS = (0, 250, 500, 1000, 2000, 3000, 4000, 5500, 8000)
LEAST_POWER = 1e-10
#: Lags of the autocorrelation that count as voiced; frames from which on a window has a modulation spectrum.
LAGS, MODULATED = (40, 268), 16
#: What a silent frame is below the clip's median, in dB.
SILENCE = 25.0
FRAMES = "clip string, frame long, e double, band array<double>, flat double, cent double, zcr double, hf double, lf double, voic double"
VERSION = 1


@lru_cache(32)
def taps(up: int, down: int) -> np.ndarray:
    """The low-pass filter between two rates: a sinc cut at the lower of the two, under a Kaiser window of 5, with gain up."""
    half = audio.reach(up, down)
    at, cut = np.arange(-half, half + 1), 1 / max(up, down)
    h = cut * np.sinc(cut * at) * np.kaiser(2 * half + 1, 5.0)
    return up * h / h.sum()


def resampled_block(x: np.ndarray, lead: int, at: int, n: int, up: int, down: int) -> np.ndarray:
    """Samples at to at + n of the new rate; x begins lead input samples before the one that at falls on."""
    if up == down:
        return x[lead : lead + n]
    half, h = audio.reach(up, down), taps(up, down)
    width = 2 * half // up + 1
    place = (at + np.arange(n)) * down
    newest = (place + half) // up  # the last input sample that each output hears
    first = at * down // up - lead
    heard = newest[:, None] - np.arange(width)
    tap = place[:, None] - heard * up + half
    there = (heard >= first) & (heard - first < len(x)) & (tap <= 2 * half)
    return (np.where(there, x[np.clip(heard - first, 0, len(x) - 1)], 0) * h[np.minimum(tap, 2 * half)]).sum(axis=1)


SAMPLES = "clip string, rate int, total long, at long, x array<float>, error string"


def resampled(blocks: DataFrame, wanted: int) -> DataFrame:
    """blocks, decoded for the wanted rate, with x of that rate: clip, rate, total, at, x and error."""
    return blocks.mapInArrow(resampling(wanted), SAMPLES)


def resampling(wanted: int):
    """What resampled() does to batches."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("clip", "rate", "total", "at", "n", "lead", "error")}
                x = None
                if row["error"] is None:
                    own = batch.column("x")[k].values.to_numpy(zero_copy_only=False).astype(np.float64)
                    parts = [resampled_block(own[max(0, lo) :], lead - max(0, lo), at, n, *audio.steps(row["rate"], wanted)) for lo, lead, at, n in pieces(row, wanted)]
                    x = np.concatenate(parts).astype(np.float32)
                values = [pa.array([row["clip"]], pa.string()), pa.array([None if x is None else wanted], pa.int32()), pa.array([row["total"]], pa.int64()), pa.array([row["at"]], pa.int64()), pa.array([None if x is None else x.tolist()], pa.list_(pa.float32())), pa.array([row["error"]], pa.string())]
                yield pa.RecordBatch.from_arrays(values, names=["clip", "rate", "total", "at", "x", "error"])

    return run


def pieces(row: dict, wanted: int, most: int = 16_384):
    """A block in parts of so many outputs, for bounded memory: where a part's input may begin, its lead, at and n."""
    up, down = audio.steps(row["rate"], wanted)
    base = row["at"] * down // up - row["lead"]  # the input sample that x begins with
    for at in range(row["at"], row["at"] + row["n"], most):
        lo = at * down // up - audio.reach(up, down) // up - 1 - base
        yield lo, at * down // up - base, at, min(most, row["at"] + row["n"] - at)


@lru_cache(1)
def spectral() -> tuple[np.ndarray, np.ndarray]:
    """The Hann window of a frame and the transform's frequencies."""
    return np.hanning(FRAME), np.fft.rfftfreq(TRANSFORM, 1 / RATE)


def frame_values(x: np.ndarray, count: int) -> dict[str, np.ndarray]:
    """What FRAMES says of the first count frames of x."""
    window, hz = spectral()
    cut = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:count]
    shaped = cut * window
    power = np.abs(np.fft.rfft(shaped, TRANSFORM, axis=1)) ** 2
    total = power.sum(axis=1)
    e = 10 * np.log10(total + LEAST_POWER)
    edges = np.searchsorted(hz, BANDS)
    band = np.add.reduceat(power[:, : edges[-1]], edges[:-1], axis=1)
    heard = power[:, (hz >= 100) & (hz <= 8000)] + LEAST_POWER
    echo = np.fft.irfft(np.abs(np.fft.rfft(shaped, 2 * TRANSFORM, axis=1)) ** 2, 2 * TRANSFORM, axis=1)
    share = lambda part: power[:, part].sum(axis=1) / (total + LEAST_POWER)
    return {
        "e": e, "band": 10 * np.log10(band + LEAST_POWER) - e[:, None], "flat": np.exp(np.log(heard).mean(axis=1)) / heard.mean(axis=1), "cent": (power * hz).sum(axis=1) / (total + LEAST_POWER),
        "zcr": (np.signbit(cut[:, 1:]) != np.signbit(cut[:, :-1])).mean(axis=1), "hf": share(hz >= 4000), "lf": share(hz < 500), "voic": echo[:, LAGS[0] : LAGS[1]].max(axis=1) / (echo[:, 0] + LEAST_POWER),
    }


def blocks_for_frames(found: DataFrame) -> DataFrame:
    """Files (clip, content) as blocks of RATE that hold all samples of the frames that begin in them."""
    decode, resample = audio.decoding(RATE, audio.BLOCK, FRAME - HOP), resampling(RATE)
    return found.select("clip", "content").mapInArrow(lambda batches: resample(decode(batches)), SAMPLES)


def frames_of_files(found: DataFrame) -> DataFrame:
    """frames() of blocks_for_frames() of files, in one pass: each pass of a stage has a worker a core of its own."""
    decode, resample, frame = audio.decoding(RATE, audio.BLOCK, FRAME - HOP), resampling(RATE), framing(audio.BLOCK)
    return found.select("clip", "content").mapInArrow(lambda batches: frame(resample(decode(batches))), FRAMES)


def frames(blocks: DataFrame, block: int = audio.BLOCK) -> DataFrame:
    """FRAMES of blocks (clip, total, at, x) of RATE and block samples, as blocks_for_frames gives them: a frame of 25 ms every 10 ms. A clip shorter than one frame is one, with silence added."""
    return blocks.where("x IS NOT NULL").select("clip", "total", "at", "x").mapInArrow(framing(block), FRAMES)


def framing(block: int):
    """What frames() does to batches; rows without samples have no frames."""
    assert block % HOP == 0

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                if not batch.column("x")[k].is_valid:
                    continue
                total, at = batch.column("total")[k].as_py(), batch.column("at")[k].as_py()
                x = batch.column("x")[k].values.to_numpy(zero_copy_only=False).astype(np.float64)
                last = max(0, total - FRAME) // HOP  # the clip's last frame
                count = min(last + 1 - at // HOP, block // HOP)
                if count <= 0:
                    continue
                own = frame_values(np.pad(x, (0, max(0, FRAME - len(x)))), count)
                band = own.pop("band")
                clip = pa.array([batch.column("clip")[k].as_py()] * count, pa.string())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * (len(BANDS) - 1), pa.int32()), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays([clip, pa.array(at // HOP + np.arange(count)), pa.array(own.pop("e")), bands, *map(pa.array, own.values())], names=["clip", "frame", "e", "band", *own])

    return run


def levels(own: DataFrame) -> DataFrame:
    """clip, n_frames and the percentiles p10, p50 and p90 of its frames' energy."""
    return own.groupBy("clip").agg(F.count("*").alias("n_frames"), *[F.percentile("e", q / 100).alias(f"p{q}") for q in (10, 50, 90)])


@F.pandas_udf(StructType([StructField("hz", DoubleType()), StructField("ratio", DoubleType())]))
def modulation(energy):
    """Of each array of energies in dB, one a frame: the strongest modulation from 2 to 10 Hz, and its share of 0.5 to 20 Hz; 0 for short ones."""
    import pandas as pd

    def one(e):
        if len(e) < MODULATED:
            return 0.0, 0.0
        swing = 10 ** (np.asarray(e) / 20)
        power = np.abs(np.fft.rfft((swing - swing.mean()) * np.hanning(len(swing)))) ** 2
        hz = np.fft.rfftfreq(len(swing), HOP / RATE)
        near, wide = np.flatnonzero((hz >= 2) & (hz <= 10)), power[(hz >= 0.5) & (hz <= 20)].sum()
        if not len(near) or wide <= 0:
            return 0.0, 0.0
        best = near[power[near].argmax()]
        return float(hz[best]), float(power[best] / (wide + LEAST_POWER))

    return pd.DataFrame([one(e) for e in energy], columns=["hz", "ratio"])


def spans(windows: DataFrame, level: DataFrame) -> DataFrame:
    """windows (clip, gap, t0, t1) with lo, hi (frames from lo to before hi, those whose centre lies inside, else the nearest one) and the clip's levels."""
    place = lambda t: (t * RATE - FRAME / 2) / HOP
    joined = windows.where("t0 IS NOT NULL AND t1 IS NOT NULL").join(level, "clip")
    lo = F.greatest(F.ceil(place(F.col("t0"))), F.lit(0))
    hi = F.least(F.floor(place(F.col("t1"))) + 1, F.col("n_frames"))
    near = F.greatest(F.lit(0), F.least(F.rint(place((F.col("t0") + F.col("t1")) / 2)).cast("long"), F.col("n_frames") - 1))
    some = joined.withColumn("lo", lo).withColumn("hi", hi).withColumn("near", near)
    return some.select("clip", "gap", "t0", "t1", "p50", "p90", F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("near")).alias("lo"), F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("near") + 1).alias("hi"))


NAMES = (
    ["dur", "e_mean", "e_std", "e_min", "e_max", "e_p10", "e_p90", "e_rel_mean", "e_rel_max"]
    + [f"band{i}_{s}" for s in ("mean", "std") for i in range(len(BANDS) - 1)]
    + ["flat_mean", "flat_std", "cent_mean", "cent_std", "zcr_mean", "zcr_std", "hf_mean", "lf_mean", "voic_mean", "voic_max", "mod_peak_hz", "mod_peak_ratio", "silence_frac"]
)


def window_features(windows: DataFrame, own: DataFrame) -> DataFrame:
    """clip, gap, t0, t1 and features (NAMES, in order) of windows (clip, gap, t0, t1) over stored frames.

    A window becomes its frames' numbers and meets the frames by clip and number, an equality that any join can shuffle; no frame
    is compared with a window that doesn't hold it. Windows without times, or of clips without frames, have no row.
    """
    asked = spans(windows, levels(own)).select("*", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("frame"))
    met = asked.join(own, ["clip", "frame"])
    mean, std = F.avg, F.stddev_pop
    bands = [f(F.get("band", F.lit(i))).alias(f"band{i}_{s}") for s, f in (("mean", mean), ("std", std)) for i in range(len(BANDS) - 1)]
    by = met.groupBy("clip", "gap", "t0", "t1").agg(
        mean("e").alias("e_mean"), std("e").alias("e_std"), F.min("e").alias("e_min"), F.max("e").alias("e_max"), F.percentile("e", 0.1).alias("e_p10"), F.percentile("e", 0.9).alias("e_p90"),
        (F.avg("e") - F.first("p50")).alias("e_rel_mean"), (F.max("e") - F.first("p90")).alias("e_rel_max"), *bands, *[f(c).alias(f"{c}_{s}") for c in ("flat", "cent", "zcr") for s, f in (("mean", mean), ("std", std))],
        mean("hf").alias("hf_mean"), mean("lf").alias("lf_mean"), mean("voic").alias("voic_mean"), F.max("voic").alias("voic_max"), F.avg((F.col("e") < F.col("p50") - SILENCE).cast("int")).alias("silence_frac"),
        F.transform(F.array_sort(F.collect_list(F.struct("frame", "e"))), lambda x: x["e"]).alias("_e"),
    )
    shaped = by.withColumn("_m", modulation("_e")).withColumns({"dur": F.col("t1") - F.col("t0"), "mod_peak_hz": F.col("_m.hz"), "mod_peak_ratio": F.col("_m.ratio")})
    return shaped.select("clip", "gap", "t0", "t1", F.array(*[F.col(c).cast("float") for c in NAMES]).alias("features"))


def of_samples(windows: DataFrame, found: DataFrame) -> DataFrame:
    """sample_id, gap and features of windows (sample_id, gap, t0, t1) from the samples' files (sample_id, content), resampled where their rate isn't RATE."""
    own = kept(frames_of_files(found.select(F.col("sample_id").alias("clip"), "content")))
    asked = windows.select(F.col("sample_id").alias("clip"), F.col("gap").cast("long").alias("gap"), "t0", "t1")
    return window_features(asked, own).select(F.col("clip").alias("sample_id"), F.col("gap").cast("int").alias("gap"), "features")


def mixed(z: np.ndarray) -> np.ndarray:
    """64 bits from a counter, by two multiplications and shifts: equal counters give equal bits on every worker."""
    z = (z + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(2**64 - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def normal(seed: int, key: int, n: int) -> np.ndarray:
    """n standard normal numbers, each drawn by the hash of its own counter."""
    with np.errstate(over="ignore"):
        start = mixed(np.array([seed & (2**63 - 1)], np.uint64) ^ mixed(np.array([key & (2**63 - 1)], np.uint64)))
        u = [(mixed(start + np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(k)) >> np.uint64(11)).astype(np.float64) / 2**53 for k in (0, 1)]
    return np.sqrt(-2 * np.log1p(-u[0])) * np.cos(2 * np.pi * u[1])


def degraded(clips: DataFrame, ratio_db: float, seed: int, when: Column) -> DataFrame:
    """clips (name, rate, x) with white noise added to x where when holds, at a ratio of signal to noise in dB; a clip's noise depends on seed and name only."""

    def run(batches):
        for batch in batches:
            out = []
            for name, value, hit in zip(batch.column("_key").to_pylist(), batch.column("x"), batch.column("_hit").to_pylist(), strict=True):
                x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if hit and len(x):
                    power = float(np.mean(x * x)) or 1e-12
                    x = np.clip(x + normal(seed, name, len(x)) * np.sqrt(power / 10 ** (ratio_db / 10)), -1, 1)
                out.append(x.astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("rate"), pa.array(out, pa.list_(pa.float32()))], names=["name", "rate", "x"])

    keyed = clips.where("x IS NOT NULL").select("name", "rate", "x", F.xxhash64("name").alias("_key"), F.coalesce(when, F.lit(False)).alias("_hit"))
    return keyed.mapInArrow(run, "name string, rate int, x array<float>")
