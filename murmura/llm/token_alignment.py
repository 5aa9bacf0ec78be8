"""Alignment of two tokenizers' tokens: union-find over the graph of overlapping tokens, then counts of linked pairs.

Both tokenizers cut the same bytes. Tokens are nodes, an edge joins an A and a B token whose byte ranges overlap, and the
connected components of this bipartite graph are exactly the minimal groups: the smallest runs of A and B tokens that cover
the same bytes. Texts are cut before spaces where neither tokenizer has a token across the cut, so that no component crosses
one; the distinct chunks of a batch are laid out as flat arrays of edges (one for each stretch between two neighbouring ends)
and their components come from one union-find. A component's members expand into its links, the A and B tokens that end
together.

A document's links are kept as distinct pairs of ids with their number, stored beside its groups. Pairs are counted over the
corpus in three steps: within a task (numpy), within a partition and over the exchange (Spark); what is shuffled is at most
the distinct pairs of each task. The most frequent pairs go to the workers as sorted arrays of at most FREQUENT entries; the
rarer ones, none of which is frequent by construction, come by a shuffled join.

Defined results: a text that is null or empty, or whose A or B tokens don't spell space + text, has no tokens: zeros and an
empty string. Strings that look like special tokens are ordinary text. Rows are handled one by one: repeated doc_ids stay
apart and null doc_ids stay null. An empty table gives no rows. Other columns, of whatever names, are not read. A very long
text, also one without spaces, costs memory in proportion to its own length.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from itertools import chain, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

#: Pairs that every worker holds, at 17 bytes each.
FREQUENT = 2_000_000
#: Characters of the texts that are tokenized together, unless a single text is longer.
CHARS = 1_000_000
#: Chunks, and characters of chunks, after which a worker's memo is emptied.
MEMO, MEMO_CHARS = 500_000, 16_000_000
#: Pairs that a task gathers before it counts them.
GATHERED = 4_000_000
#: Bits of a pair's key for the B id.
B_BITS = 32

GROUPED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


class Side:
    """The tokens of one vocabulary: bytes, lengths and printed ids."""

    def __init__(self, spelled: list[bytes], end: str):
        self.spelled = spelled
        self.width = np.array([len(t) for t in spelled], np.int64)
        ids = range(len(spelled))
        #: The id in decimal digits with what follows it inside a group, and at the end of its part of the group.
        self.open, self.closed = (np.array([b"%d%c" % (i, x) for i in ids], object) for x in (ord(","), ord(end)))


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def tokenizers_of(path_a: str, path_b: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    letters = byte_letters()
    spelled_a = [bytes(letters[c] for c in a.id_to_token(i)) if i is not None else b"" for i in range(a.get_vocab_size())]
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    spelled_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, Side(spelled_a, "|"), b, Side(spelled_b, ";")


def groups_of(width_a: np.ndarray, width_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component (0, 1, ... in order of place) of each A and of each B token; both sides' widths add up to the same bytes."""
    end_a, end_b = np.cumsum(width_a), np.cumsum(width_b)
    ends = np.union1d(end_a, end_b)
    a = np.searchsorted(end_a, ends)
    b = np.searchsorted(end_b, ends)
    root = shared.roots(len(width_a) + len(width_b), a, len(width_a) + b)
    own_a, own_b = root[: len(width_a)], root[len(width_a) :]
    # A component's root is its least index, which is its first A token.
    rank = np.cumsum(own_a == np.arange(len(own_a))) - 1
    return rank[own_a], rank[own_b]


def chunks_of(text: str) -> list[str]:
    """space + text in chunks that no token of either tokenizer spans.

    It is cut before a space that stands between a character that is no space and one that is no white space: A's pattern starts a
    match there whatever came before, and no piece of B holds a space behind another character.
    """
    pieces = text.split(" ")
    if "" not in pieces and not any(map(str.isspace, map(itemgetter(0), pieces))):
        return [" " + p for p in pieces]
    out, start = [], 0
    for k in range(1, len(pieces)):
        if pieces[k] and pieces[k - 1] and not pieces[k][0].isspace():
            out.append(" " + " ".join(pieces[start:k]))
            start = k
    return [*out, " " + " ".join(pieces[start:])]


class Memo:
    """Chunks that a worker has solved: a number each, and by number their token counts, printed groups and links."""

    def __init__(self, path_a: str, path_b: str):
        self.paths = path_a, path_b
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.printed: list[bytes] = []
        self.chars = 0
        self.sizes = np.zeros((3, 0), np.int64)  # n_a, n_b, n_groups; n_a is -1 where tokens don't spell the chunk
        self.keys, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Solves chunks that aren't known yet."""
        sizes, printed, keys = solved(chunks, *self.paths)
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks)), strict=True))
        self.printed += printed
        self.start = np.r_[self.start, len(self.keys) + np.cumsum(sizes[2]) - sizes[2]]
        self.sizes, self.keys = np.c_[self.sizes, sizes], np.r_[self.keys, keys]
        self.chars += sum(map(len, chunks))


def flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64)


def solved(chunks: list[str], path_a: str, path_b: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Per chunk n_a, n_b and n_groups (-1, 0, 0 where tokens don't spell it) and its printed groups; the keys of all links in order."""
    enc_a, side_a, enc_b, side_b = tokenizers_of(path_a, path_b)
    ids_a = [e.ids for e in enc_a.encode_batch_fast(chunks, add_special_tokens=False)]
    ids_b = enc_b.encode([c[1:] for c in chunks], num_threads=1)
    spelled = [c.encode() for c in chunks]
    size = np.array(list(map(len, spelled)), np.int64)
    whole = True
    for ids, side in ((ids_a, side_a), (ids_b, side_b)):
        own = flat(ids)
        length = np.array(list(map(len, ids)), np.int64)
        ends = np.r_[0, np.cumsum(side.width[own])][np.cumsum(length)]
        whole = whole and np.array_equal(ends, np.cumsum(size)) and b"".join(map(side.spelled.__getitem__, own.tolist())) == b"".join(spelled)
    good = np.ones(len(chunks), bool)
    if not whole:
        spells = lambda ids, side, text: b"".join(map(side.spelled.__getitem__, ids)) == text
        good = np.array([spells(x, side_a, t) and spells(y, side_b, t) for x, y, t in zip(ids_a, ids_b, spelled, strict=True)], bool)
        ids_a, ids_b = ([x if g else [] for x, g in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
    n_a, n_b = (np.array(list(map(len, ids)), np.int64) for ids in (ids_a, ids_b))
    a, b = flat(ids_a), flat(ids_b)
    if not len(a):
        return np.stack([np.where(good, 0, -1), n_b, n_b]), [b""] * len(chunks), np.zeros(0, np.int64)
    group_a, group_b = groups_of(side_a.width[a], side_b.width[b])
    last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True]
    keys = (a[last_a] << B_BITS) | b[last_b]  # a component's last tokens end together
    # The printed groups: each token with what follows it, in the order of groups, A before B.
    before_a, before_b = (np.r_[0, np.cumsum(np.bincount(g))] for g in (group_a, group_b))
    shown = np.empty(len(a) + len(b), object)
    shown[np.arange(len(a)) + before_b[group_a]] = np.where(last_a, side_a.closed[a], side_a.open[a])
    shown[np.arange(len(b)) + before_a[group_b + 1]] = np.where(last_b, side_b.closed[b], side_b.open[b])
    shown = shown.tolist()
    edge = np.r_[0, np.cumsum(np.fromiter(map(len, shown), np.int64))][np.r_[0, np.cumsum(n_a + n_b)]].tolist()
    text = b"".join(shown)
    links = np.r_[0, np.cumsum(last_a)][np.r_[0, np.cumsum(n_a)]]
    return np.stack([np.where(good, n_a, -1), n_b, np.diff(links)]), [text[i:j] for i, j in pairwise(edge)], keys


@lru_cache(2)
def memo_of(path_a: str, path_b: str) -> Memo:
    return Memo(path_a, path_b)


def align(texts: list[str | None], path_a: str, path_b: str) -> list[tuple]:
    """n_a, n_b, n_groups, groups_sha256, distinct link keys and their numbers of each text.

    Components never leave a chunk, so each distinct chunk is solved once; a worker forgets them all when they are too many.
    """
    memo = memo_of(path_a, path_b)
    if len(memo.printed) > MEMO or memo.chars > MEMO_CHARS:
        memo.clear()
    cut = [chunks_of(t) if t else [] for t in texts]
    fresh = list({c for own in cut for c in own if c not in memo.number})
    if fresh:
        memo.learn(fresh)
    out = []
    for own in cut:
        numbers = list(map(memo.number.__getitem__, own))
        sizes = memo.sizes[:, numbers]
        if not own or sizes[0].min() < 0:
            out.append((0, 0, 0, "", [], []))
            continue
        n_a, n_b, n_groups = sizes.sum(axis=1).tolist()
        text = b"".join(map(memo.printed.__getitem__, numbers))
        first = np.cumsum(sizes[2]) - sizes[2]
        at = np.arange(n_groups) + np.repeat(memo.start[numbers] - first, sizes[2])
        pairs, times = np.unique(memo.keys[at], return_counts=True)
        out.append((n_a, n_b, n_groups, hashlib.sha256(memoryview(text)[:-1]).hexdigest(), pairs, times))
    return out


def grouped(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document as GROUPED says; row tells rows apart once this is stored."""

    def run(batches):
        for batch in shared.parts(batches):
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= CHARS):
                    chars += len(texts[to] or "")
                    to += 1
                rows = align(texts[at:to], path_a, path_b)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(at, to - at), batch.column("doc_id").slice(at, to - at), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int32()))],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
                )
                at = to

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, GROUPED)


def counted(groups: DataFrame) -> DataFrame:
    """a, b, n: how many links hold each pair. Tasks count what they gather before anything is shuffled."""

    def run(batches):
        keys, times, size = [], [], 0

        def gathered():
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(place, np.concatenate(times), len(key)).astype(np.int64)

        for batch in batches:
            keys.append(batch.column("pairs").flatten().to_numpy(zero_copy_only=False))
            times.append(batch.column("times").flatten().to_numpy(zero_copy_only=False))
            size += len(keys[-1])
            if size > GATHERED:
                key, n = gathered()
                if len(key) * 2 > GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])
                    keys, times, size = [], [], 0
                else:
                    keys, times, size = [key], [n], len(key)
        if keys:
            key, n = gathered()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    return groups.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(pairs: DataFrame) -> DataFrame:
    """pairs (pair, n) with best: is n the highest of the pair's B id. B ids are at most a vocabulary's."""
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return pairs.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def least_frequent(pairs: DataFrame, room: int) -> int:
    """The least count from which on at most room pairs occur; counts of 10,000 and more are told apart by powers of two."""
    step = F.when(F.col("n") < 10_000, F.col("n")).otherwise(F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long"))
    held, floor = 0, 1 << 62
    for row in pairs.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += row["count"]
        if held > room:
            break
        floor = row["step"] if row["step"] < 10_000 else max(10_000, row["step"] // 2 + 1)
    return floor


def summed(groups: DataFrame, pairs: DataFrame, room: int) -> DataFrame:
    """groups with n_links, n_best and count_sum in place of their pairs."""
    floor = least_frequent(pairs, room)
    top = pairs.where(F.col("n") >= floor).toArrow()  # at most room rows
    order = np.argsort(top.column("pair").to_numpy())
    known = groups.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))

    def run(batches):
        key, n, best = known.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = pairs.value_lengths().to_numpy(zero_copy_only=False)
            own = pairs.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
            hit = key[at] == own if len(key) else np.zeros(len(own), bool)
            held_n = np.where(hit, n[at] if len(key) else 0, 0)
            held_best = hit & best[at] if len(key) else hit
            sums = []
            for values in (times, held_best * times, held_n * times):
                total = np.zeros(len(size), np.int64)
                np.add.at(total, doc, values)
                sums.append(total)
            rest = ~hit
            edge = np.r_[0, np.cumsum(np.bincount(doc[rest], minlength=len(size)))].astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x[rest])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")], *map(pa.array, sums), *left], names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum", "pairs", "times"])

    done = groups.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, pairs array<long>, times array<long>")
    if floor > 1:  # rarer pairs are left: none of them has many rows
        done = shared.stored(done)
        asked = done.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("t"))
        found = asked.join(pairs.where(F.col("n") < floor), "pair").groupBy("row").agg(F.sum(F.col("t") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more"))
        done = done.join(found, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_links(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Documents with their groups and link counts (GROUPED, and n_links, n_best, count_sum), and the pairs (a, b, n, best) that are linked."""
    groups = shared.stored(grouped(docs, path_a, path_b))
    pairs = shared.stored(with_best(shared.stored(counted(groups))))
    table = pairs.select(F.shiftright("pair", B_BITS).alias("a"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "n", "best")
    return summed(groups, pairs, frequent), table


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return token_links(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
