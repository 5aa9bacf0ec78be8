"""Suffix-array dedup: removes every byte covered by a string of SPAN bytes that also starts earlier.

Sparse suffix arrays. Every SPAN-byte string contains K-byte grams; the one with the least hash (leftmost among equals) is
its anchor, so equal strings have their anchor at the same place, and about one byte in twenty begins an anchor. Only
suffixes that begin at anchors are indexed, in the order of their first K bytes, which entries carry as four big-endian words;
among suffixes that agree in all of these a hash of the context stands for the bytes before and behind, all that any
SPAN-byte string through the gram can have.

Logarithmic index family. Each batch of texts gets its suffix array where it is read; entries with one gram and context
inside a batch are settled at once: all but the earliest are repeats. Arrays are then dealt by ranges of the gram's hash. In
each range a family of arrays takes them in turn: a new array is merge-scanned against the level of its size, neighbours that
have a long match (the K bytes and the context) drop out, and equal-sized levels merge geometrically, until one is left.
Neighbours with a common prefix of K bytes but another context are borders: these entries' contexts are fetched from the texts,
and each string through the gram is compared.

A batch deals to at most FAN places at once. With more ranges than that, FAN batches' arrays of one place merge there first and
are dealt on from it, so the number of arrays that are shuffled grows with the data and not with its square.

At most one entry a batch, gram and context leaves its batch unsettled, so a passage that a third of all texts share meets
no task as a third of all rows. Borders of one gram meet in one task while the gram has at most GROUP distinct contexts.
A gram of more (the ends of a passage that many texts share) is no group: where its contexts are read, CROWD of them at a
time are compared with each other, and what is then the earliest of its string goes on alone, dealt by the hash of gram,
offset and string; of each hash all but the earliest are repeats. So a string meets in one task once per CROWD contexts.

Defined results: null counts as empty; texts shorter than SPAN lose nothing and are indexed nowhere; a null doc_id comes
after all others; rows with one doc_id are ordered by their text's checksum, equal rows are one text and lose the same.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

SPAN = 100
K = 32
#: Bytes of text that one batch indexes, and that one range of the index stands for.
BATCH = 3_000_000
RANGE = 8_000_000
#: Bytes of a text whose hashes are in memory at once.
PIECE = 1_000_000
#: Places that a batch deals its array to at once.
FAN = 256
#: Distinct contexts up to which a gram is one group, and how many contexts of larger ones are compared where they are read.
GROUP = 2048
CROWD = 4096
#: Kinds of rows that borders are settled by, in the order in which a task takes them.
GRAM, WINDOW, KNOWN = range(3)
NO_ID = np.iinfo(np.int64).max
MULTIPLIER = 0x9E3779B97F4A7C15
PREFIX = ("s0", "s1", "s2", "s3")
ENTRY = np.dtype([*[(s, "<u8") for s in PREFIX], ("context", "<u8"), ("doc", "<i8"), ("sum", "<u4"), ("at", "<u4")])


def gram_hashes(raw: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k bytes (a power of two) from each position on."""
    h, m, factor = raw.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    while m < k:
        h = h[: len(h) - m] * np.uint64(factor) + h[m:]
        factor, m = factor * factor % (1 << 64), 2 * m
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, span: int = SPAN, k: int = K, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all span-byte strings of a text, and the hashes of their grams."""
    width, found, hashes = span - k + 1, [], []
    for a in range(0, len(text) - span + 1, piece):
        raw = np.frombuffer(text[a : a + piece + span - 1], np.uint8)
        h = gram_hashes(raw, k)
        low = (h & np.uint64((1 << 64) - (1 << 22))) | np.arange(len(h), dtype=np.uint64)
        m = 1
        while 2 * m <= width:
            low, m = np.minimum(low[: len(low) - m], low[m:]), 2 * m
        if m < width:
            low = np.minimum(low[: len(low) - (width - m)], low[width - m :])
        marked = np.zeros(len(h), bool)
        marked[(low & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        own = np.flatnonzero(marked)
        found.append(own + a)
        hashes.append(h[own])
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


def entries(doc: int, text: bytes, span: int = SPAN, k: int = K) -> np.ndarray:
    """The suffix array's entries of one text, not sorted."""
    at, _ = anchors(text, span, k)
    out = np.empty(len(at), ENTRY)
    raw = np.frombuffer(text, np.uint8)
    for i, name in enumerate(PREFIX):
        out[name] = raw[at[:, None] + np.arange(8 * i, 8 * i + 8)].view(">u8")[:, 0]
    side, digest = span - k, xxhash.xxh64_intdigest
    out["doc"], out["sum"], out["at"] = doc, zlib.crc32(text), at
    out["context"] = [digest(text[p - side : p + span], side) if p >= side else digest(text[: p + span], p) for p in at.tolist()]
    return out


def grams_of(run: np.ndarray) -> np.ndarray:
    """A hash of the entries' grams."""
    h = np.zeros(len(run), np.uint64)
    for name in PREFIX:
        h = mixed((h ^ run[name]).view(np.int64)).view(np.uint64)
    return h


def as_neighbour(run: np.ndarray, fields) -> np.ndarray:
    """Is each entry but the first equal in the fields to the one before."""
    same = np.ones(max(0, len(run) - 1), bool)
    for f in fields:
        same &= run[f][1:] == run[f][:-1]
    return same


def settle(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts entries into suffix order; gives those that stay and, of each gram and context, the later ones."""
    if not len(run):
        return run, run
    run = run[np.argsort(run["s0"], kind="stable")]  # stable: linear where two sorted arrays meet
    same = as_neighbour(run, ["s0"])
    ties = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    if len(ties):
        own = run[ties]
        run[ties] = own[np.lexsort([own[f] for f in ("at", "sum", "doc", "context", "s3", "s2", "s1", "s0")])]
    alike = np.r_[False, as_neighbour(run, [*PREFIX, "context"])]
    moved = np.r_[False, ~as_neighbour(run, ["doc", "sum", "at"])]
    return run[~alike], run[alike & moved]


class IndexFamily:
    """Sorted arrays of geometric sizes."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, run: np.ndarray) -> list[np.ndarray]:
        """Takes in a sorted array; gives the repeats that its merges find."""
        found = []
        while self.levels and len(self.levels[-1]) < 2 * len(run):
            run, later = settle(np.concatenate([self.levels.pop(), run]))
            found.append(later)
        self.levels.append(run)
        return found

    def close(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The one array that is left, and the last repeats."""
        found = []
        while len(self.levels) > 1:
            run, later = settle(np.concatenate([self.levels.pop(), self.levels.pop()]))
            self.levels.append(run)
            found.append(later)
        return self.levels.pop() if self.levels else np.empty(0, ENTRY), found


PACK = zstandard.ZstdCompressor(level=1)
UNPACK = zstandard.ZstdDecompressor()


def packed(run: np.ndarray) -> bytes:
    """Entries as compressed bytes, field by field and byte by byte."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(run[f]).view(np.uint8).reshape(len(run), -1).T) for f in ENTRY.names]
    return PACK.compress(b"".join(x.tobytes() for x in planes))


def unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(UNPACK.decompress(blob), np.uint8)
    n, at = len(raw) // ENTRY.itemsize, 0
    out = np.empty(n, ENTRY)
    for f in ENTRY.names:
        size = ENTRY[f].itemsize
        out[f] = np.ascontiguousarray(raw[at : at + size * n].reshape(size, n).T).view(ENTRY[f])[:, 0]
        at += size * n
    return out


def dealt(parts, batch: int, ranges: int, unit: int) -> pa.RecordBatch:
    """bucket, batch, settled, entries: (entries, are they settled) by range of the gram's hash, unit ranges being one bucket."""
    rows = []
    for part, done in parts:
        bucket = ((grams_of(part) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64) // unit
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        rows += [(int(bucket[order[a]]), batch, done, packed(part[order[a:b]])) for a, b in zip(cuts, cuts[1:], strict=False)]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "batch", "settled", "entries"])


DEALT = "bucket long, batch long, settled boolean, entries binary"


def indexed(docs: DataFrame, ranges: int, batches: int = 1, fan: int = FAN) -> DataFrame:
    """bucket, batch, settled, entries: the batches' suffix arrays by range of the gram's hash; settled ones are repeats already."""
    units = [1]
    while units[-1] * fan < ranges:
        units.append(units[-1] * fan)

    def run(rows):
        held, size, k = [], 0, TaskContext.get().partitionId() << 32
        for batch in shared.parts(rows):
            for doc, text in zip(batch.column("doc_id").to_pylist(), shared.texts_of(batch.column("text")), strict=True):
                if len(text) >= SPAN:
                    held.append(entries(NO_ID if doc is None else doc, text))
                    size += len(text)
                if size >= BATCH:
                    yield flush(held, k)
                    held, size, k = [], 0, k + 1
        if held:
            yield flush(held, k)

    def flush(held, k):
        own, later = settle(np.concatenate(held))
        return dealt([(own, False), (later, True)], k, ranges, units[-1])

    def merged(unit):
        def close(place, family, done):
            own, found = family.close()
            return dealt([(own, False), (np.concatenate([np.empty(0, ENTRY), *done, *found]), True)], place[1], ranges, unit)

        def run(rows):
            place, family, done = None, IndexFamily(), []
            for batch in shared.parts(rows, 50):
                for bucket, group, settled, blob in zip(*[batch.column(c).to_pylist() for c in ("bucket", "batch", "settled", "entries")], strict=True):
                    if (bucket, group) != place:
                        if place is not None:
                            yield close(place, family, done)
                        place, family, done = (bucket, group), IndexFamily(), []
                    if settled:
                        done.append(unpacked(blob))
                    else:
                        done += family.add(unpacked(blob))
            if place is not None:
                yield close(place, family, done)

        return run

    arrays = docs.select("doc_id", "text").mapInArrow(run, DEALT)
    for unit in reversed(units[:-1]):
        batches = -(-batches // fan)
        grouped = arrays.withColumn("batch", F.pmod(F.xxhash64("batch"), F.lit(batches)))
        arrays = grouped.repartition(ranges, "bucket", "batch").sortWithinPartitions("bucket", "batch").mapInArrow(merged(unit), DEALT)
    return arrays


def matches(index: DataFrame, ranges: int, group: int = GROUP) -> DataFrame:
    """doc, sum, at, gram, many: entries that repeat an earlier one (gram is null) and entries that share their gram with others (many: with more than group)."""
    names = ["doc", "sum", "at", "gram", "many"]

    def rows(run, many=None):
        settled = np.full(len(run), many is None)
        gram = pa.array(grams_of(run).view(np.int64), mask=settled)
        return pa.RecordBatch.from_arrays([pa.array(run["doc"]), pa.array(run["sum"].astype(np.int64)), pa.array(run["at"].astype(np.int64)), gram, pa.array(~settled if many is None else many, mask=settled)], names=names)

    def run(batches):
        family, place = IndexFamily(), None
        for batch in shared.parts(batches, 50):
            for bucket, settled, blob in zip(batch.column("bucket").to_pylist(), batch.column("settled").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if bucket != place:
                    yield from close(family)
                    place = bucket
                part = unpacked(blob)
                if settled:
                    yield rows(part)
                else:
                    for later in family.add(part):
                        yield rows(later)
        yield from close(family)

    def close(family):
        whole, found = family.close()
        for later in found:
            yield rows(later)
        same = as_neighbour(whole, PREFIX)
        if same.any():
            edges = np.r_[0, np.flatnonzero(~same) + 1, len(whole)]
            size = np.repeat(np.diff(edges), np.diff(edges))
            yield rows(whole[size > 1], size[size > 1] > group)

    return index.repartition(ranges, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, sum long, at long, gram long, many boolean")


def fetched(texts: DataFrame, border: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Three kinds of rows, for the border entries.

    GRAM: gram, doc, sum, at, left and context of an entry. WINDOW, for entries of many: a string that no earlier entry of
    its crowd has, with its hash as gram and its bytes before the entry as left. KNOWN: of those, what is a repeat already,
    as at (start) and left (end).
    """
    asked = border.groupBy("doc", "sum").agg(F.collect_list(F.struct("at", "gram", "many")).alias("asked"))
    joined = texts.join(asked, ["doc", "sum"])
    side = SPAN - K

    def batch_of(kind, gram, doc, total, at, left, context=None):
        n = len(gram)
        own = pa.nulls(n, pa.binary()) if context is None else pa.array(context, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind)), *[pa.array(c, pa.int64()) for c in (gram, doc, total, at, left)], own], names=["kind", "gram", "doc", "sum", "at", "left", "context"])

    def crowded(held):
        gram, doc, total, at, left = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:5])
        whole, fits, order = strings(doc, total, at, left, [x[5] for x in held])
        gram, doc, total, at = gram[order], doc[order], total[order], at[order]
        lead = leaders(keyed(gram, whole), fits)
        hit = later(lead, fits, doc, total, at)
        row, low, high = stretches(hit)
        start = at[row] - (high - 1)
        yield batch_of(KNOWN, mixed(doc[row] ^ at[row]), doc[row], total[row], start, at[row] - low + SPAN)
        row, offset = np.nonzero(fits & (lead == np.arange(len(order))[:, None]))
        key = keyed(gram, whole)[row, offset].view(np.int64)
        for a in range(0, len(row), 50_000):
            r = row[a : a + 50_000]
            yield batch_of(WINDOW, key[a : a + 50_000], doc[r], total[r], at[r], offset[a : a + 50_000])

    def run(batches):
        held = []
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = []
                for doc, total, text, asked in zip(part.column("doc").to_pylist(), part.column("sum").to_pylist(), shared.texts_of(part.column("text")), part.column("asked").to_pylist(), strict=True):
                    for x in asked:
                        p = x["at"]
                        (held if x["many"] else rows).append((x["gram"], doc, total, p, min(p, side), text[max(0, p - side) : p + SPAN]))
                if rows:
                    yield batch_of(GRAM, *zip(*rows, strict=True))
                while len(held) >= crowd:
                    yield from crowded(held[:crowd])
                    held = held[crowd:]
        if held:
            yield from crowded(held)

    return joined.mapInArrow(run, "kind long, gram long, doc long, sum long, at long, left long, context binary")


def mixed(values: np.ndarray) -> np.ndarray:
    """Whole numbers whose bits depend on all bits of the given ones."""
    h = values.astype(np.int64).view(np.uint64) * np.uint64(MULTIPLIER)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def keyed(gram: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """entries x offsets: hash of gram, offset and string."""
    offset = np.arange(whole.shape[1], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (mixed(gram).view(np.uint64)[:, None] + offset[None, :]) * np.uint64(MULTIPLIER) ^ whole
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def strings(doc, total, at, left, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """entries x offsets: hash of the string that begins so many bytes before the gram, and if there is one; and the order of the entries, by place."""
    side = SPAN - K
    order = np.lexsort((at, total, doc))
    table = np.zeros((len(order), side + SPAN), np.uint8)
    for row, i in enumerate(order.tolist()):
        table[row, side - left[i] : side - left[i] + len(contexts[i])] = np.frombuffer(contexts[i], np.uint8)
    ends = side - left[order] + np.array([len(contexts[i]) for i in order.tolist()])
    h = {1: table.astype(np.uint64) + np.uint64(1)}
    factor = MULTIPLIER
    for m in (1, 2, 4, 8, 16, 32):
        h[2 * m] = h[m][:, :-m] * np.uint64(factor) + h[m][:, m:]
        factor = factor * factor % (1 << 64)
    odd = np.uint64(0xBF58476D1CE4E5B9)
    a = side - np.arange(side + 1)
    whole = ((h[64][:, a] * odd + h[32][:, a + 64]) ^ (h[32][:, a + 64] >> np.uint64(7))) * odd + h[4][:, a + 96]
    fits = (left[order][:, None] >= np.arange(side + 1)[None, :]) & (ends[:, None] >= a[None, :] + SPAN)
    return whole, fits, order


def leaders(whole: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """entries x offsets: the first entry that has the same string."""
    out = np.zeros(whole.shape, np.int64)
    for offset in range(whole.shape[1]):
        rows = np.flatnonzero(fits[:, offset])
        _, first, back = np.unique(whole[rows, offset], return_index=True, return_inverse=True)
        out[rows, offset] = rows[first][back]
    return out


def later(lead: np.ndarray, fits: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """entries x offsets: is the first entry with the same string another one."""
    out = np.zeros(lead.shape, bool)
    for column in place:
        out |= column[lead] != column[:, None]
    return out & fits


def repeated(doc, total, at, left, contexts: list[bytes]) -> np.ndarray:
    """entries x offsets: does an earlier entry have the same string that begins so many bytes before the gram."""
    whole, fits, order = strings(doc, total, at, left, contexts)
    result = np.empty(fits.shape, bool)
    result[order] = later(leaders(whole, fits), fits, doc[order], total[order], at[order])
    return result


def stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, first and end of each run of offsets that are hit."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    return row, low, np.nonzero(edge == -1)[1]


def resolved(contexts: DataFrame, chunk: int = 8192) -> DataFrame:
    """doc, sum, start, end: bytes that the borders' repeats cover."""
    names = ["doc", "sum", "start", "end"]

    def covered(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def cover(table: pa.Table):
        doc, total, at, left = (table.column(c).to_numpy() for c in ("doc", "sum", "at", "left"))
        row, low, high = stretches(repeated(doc, total, at, left, table.column("context").to_pylist()))
        return covered(doc[row], total[row], at[row] - (high - 1), at[row] - low + SPAN)

    def grams(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk:
                table = pa.Table.from_batches(held).combine_chunks()
                gram = table.column("gram").to_numpy()
                cuts = np.flatnonzero(gram[1:] != gram[:-1]) + 1
                if len(cuts):
                    done = 0
                    for c in [*cuts[np.flatnonzero(np.diff(cuts // chunk))].tolist(), int(cuts[-1])]:
                        if c > done:
                            yield cover(table.slice(done, c - done))
                            done = c
                    held = table.slice(done).to_batches()
        if held:
            yield cover(pa.Table.from_batches(held))

    def windows(batch, first):
        """The repeats among rows sorted by hash and place; first is the hash and place that leads the last hash so far."""
        rows = np.stack([batch.column(c).to_numpy() for c in ("gram", "doc", "sum", "at")])
        offset = batch.column("left").to_numpy()
        if first is not None:
            rows, offset = np.c_[first, rows], np.r_[0, offset]
        opens = np.r_[True, rows[0, 1:] != rows[0, :-1]]
        lead = rows[:, np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))]
        own = np.flatnonzero((lead != rows).any(0))
        start = rows[3, own] - offset[own]
        return covered(rows[1, own], rows[2, own], start, start + SPAN), lead[:, -1]

    def run(batches):
        first = None

        def others():
            """Of each batch the GRAM rows, which come first; the other kinds' results are put aside until they are asked for."""
            for batch in batches:
                kind = batch.column("kind").to_numpy()
                n = int(np.searchsorted(kind, WINDOW))
                if n:
                    yield batch.slice(0, n)
                if n < batch.num_rows:
                    rest.append(batch.slice(n))
                    return

        rest = []
        yield from grams(others())
        for batch in (b for source in (rest, batches) for b in source):
            n = int(np.searchsorted(batch.column("kind").to_numpy(), KNOWN))
            if n:
                found, first = windows(batch.slice(0, n), first)
                yield found
            if n < batch.num_rows:
                part = batch.slice(n)
                yield covered(*[part.column(c) for c in ("doc", "sum", "at", "left")])

    return contexts.repartition("gram").sortWithinPartitions("kind", "gram", "doc", "sum", "at").mapInArrow(run, "doc long, sum long, start long, end long")


def repeats(docs: DataFrame, group: int = GROUP, crowd: int = CROWD, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """doc, sum and text of every row of docs; and, per doc and sum, the covered stretches (start, end) as ranges."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, size // RANGE)
    found = shared.stored(matches(indexed(docs, ranges, -(-size // BATCH), fan), ranges, group))
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("sum"), "text")
    border = resolved(fetched(texts, found.where("gram IS NOT NULL"), crowd))
    whole = found.where("gram IS NULL").select("doc", "sum", F.greatest(F.col("at") - (SPAN - K), F.lit(0)).alias("start"), (F.col("at") + SPAN).alias("end"))
    return texts, border.union(whole).groupBy("doc", "sum").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def kept_of(text: bytes, ranges) -> tuple[bytes, int]:
    """The bytes that stay, and the number of maximal runs that go."""
    parts, at, spans = [], 0, 0
    for start, end in sorted((x["start"], x["end"]) for x in ranges or ()):
        if start > at or not spans:
            parts.append(text[at:start])
            spans, at = spans + 1, end
        else:
            at = max(at, end)
    parts.append(text[at:])
    return b"".join(parts), spans


def dedup(docs: DataFrame, group: int = GROUP, crowd: int = CROWD, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row of docs (doc_id, text)."""
    texts, covered = repeats(docs, group, crowd, fan)
    joined = texts.join(covered, ["doc", "sum"], "left")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = shared.texts_of(part.column("text"))
                cut = [kept_of(t, r) for t, r in zip(texts, part.column("ranges").to_pylist(), strict=True)]
                doc = [None if d == NO_ID else d for d in part.column("doc").to_pylist()]
                columns = [doc, [len(t) for t in texts], [len(t) - len(k) for t, (k, _) in zip(texts, cut, strict=True)], [n for _, n in cut]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([k for k, _ in cut], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@query("op8_suffix")
def op8_suffix(spark, sf_dir):
    cut = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
