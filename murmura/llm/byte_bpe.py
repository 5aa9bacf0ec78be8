"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves every pre-token that is a token as a whole. It hashes and
displaces: each bucket of keys has one displacement under which its keys fall on slots of their own; buckets of one key
name their slot. A slot's stored token is compared, so strangers never match. Second tier: what misses is merged as a
linked list of bytes, with a heap of adjacent pairs by (rank, position) and stale entries skipped when they surface.

A text is cut at its single spaces before the pattern is applied: where no space is followed by white space or the end, a
pre-token of a pattern that takes a space only as its first character never crosses such a cut. Encoded words and pre-tokens
are kept per Python worker in memos of at most MEMO entries each. Nothing is shuffled or broadcast; the rank file is read on
each worker from its (parameter) path and has a fixed size.

Defined results: null or empty text has no ids and decodes to no bytes; strings that look like special tokens are
ordinary text; null ids stand for no bytes; ids out of the vocabulary make decode() fail. Rows are encoded one by one, so repeated
rows agree; an empty table gives no rows; a long text costs memory in proportion to its length.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

MEMO = 300_000
#: Words and pre-tokens of more characters are not remembered.
MEMO_CHARS = 64
#: With so few, a seventh of the slots is left for buckets of one key, so displacements are found in a few dozen trials.
KEYS_PER_BUCKET = 2
#: Where this is found, a text is not cut into words.
UNCUT = regex.compile(r" (?:\s|\Z)")


class PerfectHash:
    """A minimal perfect hash from byte strings to 0 .. n-1, which tells strangers apart."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // KEYS_PER_BUCKET)
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh64_intdigest(key)
            groups[h % self.buckets].append((h, key))
        self.shift = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * self.n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in order:
            if len(groups[b]) < 2:
                break
            d = 1
            while True:
                at = [self.place(h, d) for h, _ in groups[b]]
                if len(set(at)) == len(at) and all(self.slots[i] is None for i in at):
                    break
                d += 1
            self.shift[b] = d
            for i, (_, key) in zip(at, groups[b], strict=True):
                self.slots[i] = key
        free = (i for i, key in enumerate(self.slots) if key is None)
        for b in order:
            if len(groups[b]) == 1:
                i = next(free)
                self.slots[i], self.shift[b] = groups[b][0][1], -1 - i

    def place(self, h: int, d: int) -> int:
        return ((h >> 20) + d * (h >> 42 | 1)) % self.n

    def find(self, key: bytes) -> int:
        """The key's slot, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        i = -1 - d if d < 0 else self.place(h, d)
        return i if self.slots[i] == key else -1


class Memo(dict):
    """make's results by key, at most MEMO of them."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.whole = PerfectHash(list(ranks))
        self.rank_at = [ranks[key] for key in self.whole.slots]
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.base = max(ranks.values()) + 1
        tokens = [b""] * self.base
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            tokens[rank] = token
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a * self.base + b] = rank
        self.first = [self.pairs.get(a * self.base + b, -1) for a in self.byte for b in self.byte]
        self.tokens = pa.array(tokens, pa.large_binary())
        self.pieces, self.words = Memo(self.piece), Memo(lambda word: self.cut(" " + word))

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a pre-token that is none itself."""
        ids, n, get, base = [self.byte[b] for b in piece], len(piece), self.pairs.get, self.base
        best = [self.first[a << 8 | b] for a, b in pairwise(piece)] + [-1]  # rank of the pair that starts here, or -1
        bits = 14 if n < 1 << 14 else 32  # so that a short piece's heap holds small integers
        low = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(best) if r >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & low, top >> bits
            if best[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], best[i], best[j] = rank, -1, -1, -1
            if k < n:
                before[k] = i
                r = best[i] = get(rank * base + ids[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0:
                r = best[h] = get(ids[h] * base + rank, -1)
                if r >= 0:
                    heapq.heappush(heap, r << bits | h)
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        """The ids of a pre-token, four bytes each."""
        raw = text.encode()
        slot = self.whole.find(raw)
        return array("i", [self.rank_at[slot]] if slot >= 0 else self.merged(raw)).tobytes()

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        if UNCUT.search(text):
            return self.cut(text)
        first, *words = text.split(" ")
        return self.cut(first) + b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str]) -> pa.ListArray:
        packed = [self.packed(t) for t in texts]
        ends = np.cumsum([0, *map(len, packed)]) // 4
        ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)

    def decode(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The tokens of all ids lie one after another, so a row's bytes are a slice of them."""
        flat = ids.flatten()
        if not len(flat):
            return pa.array([b""] * len(ids), pa.binary())
        _, token_ends, data = self.tokens.take(flat).buffers()
        rows = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_numpy()])
        ends = np.frombuffer(token_ends, np.int64)[rows]
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), data]).cast(pa.binary())


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, with_bytes: bool = False) -> DataFrame:
    """df with token_ids array<int> in place of its text column (and of one of that name); with_bytes also what decode() makes of them, by the same workers."""
    keep = shared.others(df, "text", "token_ids", *(["decoded"] if with_bytes else []))
    df = df.select(*[F.col(f"`{c}`") for c in keep], "text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text"] + ["token_ids array<int>", *(["decoded binary"] if with_bytes else [])])

    def run(batches):
        own = codec(path, pattern)
        for part in shared.parts(batches):
            ids = own.encode([t or "" for t in part.column("text").to_pylist()])
            made = {"token_ids": ids, **({"decoded": own.decode(ids)} if with_bytes else {})}
            yield pa.RecordBatch.from_arrays([*shared.columns_of(part, keep), *made.values()], names=[*keep, *made])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """df, which has token_ids, with the bytes that they stand for as decoded (which replaces a column of that name)."""
    keep = shared.others(df, "decoded")
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["decoded binary"])

    def run(batches):
        own = codec(path, pattern)
        for part in shared.parts(batches):
            yield pa.RecordBatch.from_arrays([*shared.columns_of(part, keep), own.decode(part.column("token_ids"))], names=[*keep, "decoded"])

    return df.mapInArrow(run, schema)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids of every document."""
    coded = encode(docs.select("doc_id", "source", "text"), *vocabulary())
    return coded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


@query("op6_byte_bpe")
def op6_byte_bpe(spark, sf_dir):
    """Texts are encoded and decoded in one pass: a second one would have workers, and tables, of its own beside the first."""
    both = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary(), with_bytes=True)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
