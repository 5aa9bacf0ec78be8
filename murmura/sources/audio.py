"""Audio files: WAV as a source (headers, samples in blocks) and as a sink.

A file is a row of Spark's binaryFile source; what can't be read is a row with an error. Samples are mono: the mean of the
channels, in -1 to 1. A clip comes in blocks, so that a long one is many rows: block rows hold clip, rate, total (samples of the
clip), at and n (the block's first sample and its number of samples), lead (how many samples before at are there for filters) and x.
"""

from __future__ import annotations

import struct
from itertools import islice
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a block at the wanted rate: 400 hops of 160, four seconds at 16 kHz.
BLOCK = 64_000
#: Fixed values of the format: kinds of samples by number, and the number that says that an extension names the kind.
PCM, FLOAT, EXTENDED = 1, 3, 0xFFFE
BLOCKS = "clip string, rate int, total long, at long, n long, lead long, x array<float>, error string"


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """clip (the path) and content of the WAV files under paths, folders included."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(paths)
    return found.select(F.col("path").alias("clip"), "content")


def of_samples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """sample_id (the file's name without its ending) and content of the WAV files under paths."""
    return files(spark, paths).select(F.regexp_extract("clip", r"([^/]+)\.[^.]*$", 1).alias("sample_id"), "content")


class Header:
    """What a WAV file says of itself; ValueError where it isn't one."""

    def __init__(self, raw: bytes):
        if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
            raise ValueError("not a WAV file")
        at, form = 12, None
        while at + 8 <= len(raw):
            name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
            at += 8
            if name == b"fmt ":
                if size < 16 or at + size > len(raw):
                    raise ValueError("torn header")
                form = struct.unpack_from("<HHIIHH", raw, at)
                kind = struct.unpack_from("<H", raw, at + 24)[0] if form[0] == EXTENDED and size >= 26 else form[0]
            elif name == b"data":
                if form is None:
                    raise ValueError("samples before their format")
                break
            at += size + size % 2
        else:
            raise ValueError("no samples")
        self.channels, self.rate, self.width, self.bits = form[1], form[2], form[4], form[5]
        sizes = {PCM: (8, 16, 24, 32), FLOAT: (32, 64)}
        if self.bits not in sizes.get(kind, ()) or not self.channels or not self.rate or self.width != self.channels * self.bits // 8:
            raise ValueError("unknown format")
        if at + size > len(raw):
            raise ValueError("torn samples")
        self.kind, self.at, self.frames = kind, at, size // self.width
        if not self.frames:
            raise ValueError("empty audio")

    def samples(self, raw: bytes) -> np.ndarray:
        """Mono samples, float32."""
        own = np.frombuffer(raw, np.uint8, self.frames * self.width, self.at)
        if self.kind == FLOAT:
            x = own.view("<f4" if self.bits == 32 else "<f8").astype(np.float32)
        elif self.bits == 8:
            x = (own.astype(np.float32) - 128) / 128
        elif self.bits == 24:
            wide = np.zeros((len(own) // 3, 4), np.uint8)
            wide[:, 1:] = own.reshape(-1, 3)
            x = (wide.view("<i4")[:, 0] / 2.0**31).astype(np.float32)
        else:
            x = (own.view(f"<i{self.bits // 8}") / 2.0 ** (self.bits - 1)).astype(np.float32)
        x = x.reshape(-1, self.channels)
        x = x[:, 0] if self.channels == 1 else x.mean(axis=1, dtype=np.float32)
        if not np.isfinite(x).all():
            raise ValueError("samples that are no numbers")
        return x


def each(batches):
    """clip and bytes of each file, one at a time; null content counts as empty."""
    for batch in batches:
        for k in range(batch.num_rows):
            value = batch.column("content")[k]
            yield batch.column("clip")[k].as_py(), b"" if not value.is_valid else value.as_buffer().to_pybytes()


def probed(found: DataFrame) -> DataFrame:
    """clip, rate, channels, bits, frames, seconds and error of files (clip, content); no sample is decoded."""
    schema = pa.schema([("clip", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("seconds", pa.float64()), ("error", pa.string())])

    def rows(batches):
        for clip, raw in each(batches):
            try:
                h = Header(raw)
                row = [clip, h.rate, h.channels, h.bits, h.frames, h.frames / h.rate, None]
            except (ValueError, struct.error) as e:
                row = [clip, None, None, None, None, None, str(e)]
            yield row

    def run(batches):
        own = rows(batches)
        for some in iter(lambda: list(islice(own, 1000)), []):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return found.select("clip", "content").mapInArrow(run, "clip string, rate int, channels int, bits int, frames long, seconds double, error string")


def steps(rate: int, wanted: int) -> tuple[int, int]:
    """up and down: the least whole numbers with wanted / rate = up / down."""
    g = gcd(rate, wanted)
    return wanted // g, rate // g


def reach(up: int, down: int) -> int:
    """Taps on each side of the low-pass filter between two rates; none where they are equal."""
    return 10 * max(up, down) if up != down else 0


def decoded(found: DataFrame, wanted: int | None = None, block: int | None = BLOCK, tail: int = 0) -> DataFrame:
    """BLOCKS of files (clip, content), in the file's own samples: what a block of the wanted rate needs is in one row.

    at, n and total count samples of the wanted rate (the file's own, if none is wanted); a block holds tail samples of the next
    one too, where there is one. Without block a clip is one row. x begins lead input samples before the one that at falls on.
    """
    return found.select("clip", "content").mapInArrow(decoding(wanted, block, tail), BLOCKS)


def decoding(wanted: int | None = None, block: int | None = BLOCK, tail: int = 0):
    """What decoded() does to batches of files, for steps that go on with the blocks in the same pass."""

    def rows(batches):
        for clip, raw in each(batches):
            try:
                h = Header(raw)
                x = h.samples(raw)
            except (ValueError, struct.error) as e:
                yield clip, None, None, None, None, None, None, str(e)
                continue
            up, down = steps(h.rate, wanted or h.rate)
            total, half = -(-h.frames * up // down), reach(up, down)
            for at in range(0, total, block or total):
                n = min((block or total) + tail, total - at)
                first = max(0, -((half - at * down) // up))
                last = min(h.frames, ((at + n - 1) * down + half) // up + 1)
                yield clip, h.rate, total, at, n, at * down // up - first, x[first:last], None

    def run(batches):
        some, held = [], 0
        for row in rows(batches):
            some.append(row)
            held += 0 if row[6] is None else len(row[6])
            if len(some) == 1000 or held > 1 << 18:
                yield batch_of(some)
                some, held = [], 0
        if some:
            yield batch_of(some)

    def batch_of(some):
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), None, pa.string()]
        names = ["clip", "rate", "total", "at", "n", "lead", "x", "error"]
        columns = list(zip(*some, strict=True))
        x = [np.zeros(0, np.float32) if v is None else v for v in columns[6]]
        cuts = pa.array(np.r_[0, np.cumsum([len(v) for v in x])].astype(np.int32))
        lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x)), mask=pa.array([v is None for v in columns[6]]))
        return pa.RecordBatch.from_arrays([lists if k is None else pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)

    return run


def wav(x: np.ndarray, rate: int) -> bytes:
    """A WAV file of 16 bits and one channel; samples are clipped to -1 to 1."""
    data = np.rint(np.clip(np.asarray(x, np.float64), -1, 1) * 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, PCM, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data


def encoded(clips: DataFrame) -> DataFrame:
    """name and content of clips (name, rate, x): WAV files as bytes."""

    def run(batches):
        for batch in batches:
            made = [wav(x.values.to_numpy(zero_copy_only=False), r) for x, r in zip(batch.column("x"), batch.column("rate").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(made, pa.binary())], names=["name", "content"])

    return clips.select("name", "rate", F.coalesce("x", F.array().cast("array<float>")).alias("x")).mapInArrow(run, "name string, content binary")
