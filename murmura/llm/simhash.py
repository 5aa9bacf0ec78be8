"""SimHash near-duplicates, linked by pivot distance tables.

Fingerprints are computed where a text is read. Only distinct fingerprints go on, so copies cost nothing. A pivot table
discards pairs but finds none, so fingerprints first meet in coarse cells: two that differ in at most LINK bits agree on at
least BLOCKS - LINK of BLOCKS bit blocks, and each is put into one cell per choice of that many blocks. A cell is let grow to
STRANGERS unrelated members, and there the pivot tables do the work: each member's Hamming distances to the PIVOTS reference
fingerprints are computed once as a row of small integers, pairs whose rows differ by more than LINK in any coordinate are
discarded (the triangle inequality), and only what survives is verified on the fingerprints themselves.
A cell never emits its pairs: it returns a spanning forest of its verified links.

A cell of more than CELL members is dealt to finer cells, by one of LINK + 1 blocks of the bits that it leaves free, where that
at least halves the pairs to look at, up to FINER times. Members that stay together however they are dealt (fingerprints around one
another) are cut into at most PARTS parts, and each pair of parts is a group of its own. A member thus has at most (LINK + 1)^FINER
times PARTS rows in a cell, whatever the cell's size, and no pair is lost.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and link like any other; rows with
one doc_id are one document with several fingerprints' links; a null doc_id is no component's name unless all are
null; an empty table gives no row.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

SHINGLE = 4
LINK = 4
SEED = 42
CELL = 2048
#: How often a full cell is dealt to finer ones, and the parts that one is cut into where that doesn't help.
FINER, PARTS = 2, 32
#: Unrelated fingerprints that a cell may hold: what the pivot tables are there to discard.
STRANGERS = 256
#: Reference fingerprints: as far apart as random ones are. Of random pairs one pivot leaves 57 %, eight leave 1.5 %.
PIVOTS = tuple(xxhash.xxh64_intdigest(f"pivot {k}") for k in range(32))
#: Pivots by which all pairs of a cell are looked at; the others look at what these leave.
FIRST = 6


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(line, SEED)]
    else:
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        raw = np.array(hashes[at : at + 65536], "<u8").view(np.uint8)
        ones += np.unpackbits(raw, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(df: DataFrame) -> DataFrame:
    """df, which has a text column, with fp (64 bits as a long) in its place."""
    keep = [c for c in df.columns if c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text"] + ["fp long"])

    def run(batches):
        for batch in shared.parts(batches):
            fps = pa.array([fingerprint(t) for t in shared.texts_of(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*shared.columns_of(batch, keep), fps], names=[*keep, "fp"])

    return df.mapInArrow(run, schema)


def masks(blocks: int, agree: int) -> list[int]:
    """For each choice of so many of the bit blocks, the mask of their bits, as a signed long."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [signed(sum(choice)) for choice in combinations(own, agree)]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def blocks_for(n: int, link: int = LINK) -> int:
    """The least number of blocks, link + 1 to link + 5, whose cells hold at most STRANGERS of n unrelated fingerprints."""
    blocks = link + 1
    while blocks < link + 5 and n >> (64 // blocks * (blocks - link)) > STRANGERS:
        blocks += 1
    return blocks


def near(column, other, link: int):
    """Are two fingerprints linked: by the pivot tables first, then by themselves."""
    far = [F.abs(F.bit_count(column.bitwiseXOR(p)) - F.bit_count(other.bitwiseXOR(p))) for p in (F.lit(signed(x)) for x in PIVOTS)]
    return (F.greatest(*far) <= link) & (F.bit_count(column.bitwiseXOR(other)) <= link)


def forest_of(link: int):
    """A cell's handler: the spanning forest of the verified links among its members."""
    pivots = np.array(PIVOTS, np.uint64)

    def handle(table: pa.Table):
        own = np.unique(table.column("fp").to_numpy().view(np.uint64))
        n = len(own)
        tables = np.bitwise_count(own[:, None] ^ pivots[None, :]).astype(np.int8)
        coordinates = np.ascontiguousarray(tables.T)
        root = np.arange(n)
        for at in range(0, n - 1, 256):
            end = min(n, at + 256)
            alive = np.arange(at, n)[None, :] > np.arange(at, end)[:, None]
            for row in coordinates[:FIRST]:
                alive &= np.abs(row[at:end, None] - row[None, at:]) <= link
            a, b = np.nonzero(alive)
            a, b = a + at, b + at
            for k in range(FIRST, len(pivots), FIRST):
                if not len(a):
                    break
                left = np.abs(tables[a, k : k + FIRST] - tables[b, k : k + FIRST]).max(1) <= link
                a, b = a[left], b[left]
            linked = np.bitwise_count(own[a] ^ own[b]) <= link
            root = shared.roots(n, a[linked], b[linked], root)
        far = np.flatnonzero(root != np.arange(n))
        return [own[far].view(np.int64), own[root[far]].view(np.int64)] if len(far) else None

    return handle


def finer(members: DataFrame, link: int) -> DataFrame:
    """members (m, v, n, fp: a cell's mask, its bits under it, its size and a member) with fm and fv, the finer cells that each member goes to.

    The bits that a cell leaves free are cut into link + 1 blocks: two linked members agree on at least one of them.
    """

    def cut_of(mask: int) -> np.ndarray:
        free = [b for b in range(64) if not mask >> b & 1]
        return np.array([signed(mask % 2**64 | sum(1 << int(b) for b in part)) for part in np.array_split(free, link + 1)], np.int64)

    def run(batches):
        for batch in batches:
            mask, fp = batch.column("m").to_numpy(), batch.column("fp").to_numpy()
            own, place = np.unique(mask, return_inverse=True)
            cuts = np.stack([cut_of(int(m) % 2**64) for m in own]) if len(own) else np.zeros((0, link + 1), np.int64)
            fm = cuts[place].ravel()
            again = pa.array(np.repeat(np.arange(len(fp)), link + 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(again) for c in ("m", "v", "n", "fp")], pa.array(fm), pa.array(np.repeat(fp, link + 1) & fm)], names=["m", "v", "n", "fp", "fm", "fv"])

    return members.mapInArrow(run, "m long, v long, n long, fp long, fm long, fv long")


def links(fps: DataFrame, link: int = LINK, cell: int = CELL) -> DataFrame:
    """a, b: edges that connect the fingerprints (distinct, column fp) as their links do."""
    blocks = blocks_for(fps.count(), link)
    keys = masks(blocks, blocks - link)
    level = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in keys])).alias("m")).select("m", F.col("fp").bitwiseAND(F.col("m")).alias("v"), "fp")
    edge, out = pa.schema([("a", pa.int64()), ("b", pa.int64())]), []
    for depth in range(FINER + 1):
        cells = shared.stored(level.groupBy("m", "v").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
        out.append(cells.where("n = 2").where(near(F.col("a"), F.col("b"), link)).select("a", "b"))
        one = F.lit(0).cast("long")
        groups = level.join(cells.where((F.col("n") > 2) & (F.col("n") <= cell)).select("m", "v"), ["m", "v"]).select("m", "v", "fp", one.alias("p"), one.alias("q"))
        full = cells.where(F.col("n") > cell).select("m", "v", "n")
        more = not full.isEmpty()
        if more:
            members = shared.stored(level.join(full, ["m", "v"]).select("m", "v", "n", "fp"))
            left = members
            if depth < FINER:
                dealt = shared.stored(finer(members, link))
                work = dealt.groupBy("m", "v", "n", "fm", "fv").agg(F.count("*").alias("c")).groupBy("m", "v", "n").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs"))
                helped = shared.stored(work.where(2 * F.col("pairs") <= F.col("n").cast("double") * F.col("n")).select("m", "v"))
                left = members.join(helped, ["m", "v"], "left_anti")
                level = dealt.join(helped, ["m", "v"]).select(F.col("fm").alias("m"), F.col("fv").alias("v"), "fp")
            parts = F.least(F.ceil(F.col("n") / F.lit(cell)), F.lit(PARTS))
            left = left.select("m", "v", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).alias("p"))
            left = left.select("m", "v", "fp", "p", F.explode(F.sequence(one, F.col("parts") - 1)).alias("q"))
            groups = groups.unionByName(left.select("m", "v", "fp", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")))
        out.append(shared.by_group(groups, ["m", "v", "p", "q"], forest_of(link), edge))
        if not more:
            break
    return reduce(DataFrame.union, out)


def rooted(fps: DataFrame, link: int = LINK) -> DataFrame:
    """fps (distinct fingerprints, column fp) with c, the component's own fingerprint."""
    joined = shared.components(links(fps.select("fp"), link))
    return fps.join(joined, fps["fp"] == joined["node"], "left").select(*[fps[c] for c in fps.columns], F.coalesce("component", "fp").alias("c"))


def classes(marked: DataFrame, link: int = LINK) -> DataFrame:
    """fp and component_id (the smallest doc_id reachable) of every fingerprint of marked (doc_id, fp)."""
    named = rooted(shared.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"))), link)
    smallest = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return named.join(smallest, "c").select("fp", "component_id")


def group(docs: DataFrame, link: int = LINK) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    marked = shared.stored(with_fingerprints(docs.select("doc_id", "text")))
    return marked.join(classes(marked, link), "fp").select("doc_id", "fp", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the first by doc_id (null last), fingerprint and checksum of the text (of rows equal in these, any one).

    A row goes only for sharing a component: ids may be null or repeated, so rows are known by id and checksum.
    """
    total = F.xxhash64("text")
    marked = with_fingerprints(docs.select("doc_id", total.alias("sum"), "text")).groupBy("doc_id", "sum", "fp").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "sum", "n")).alias("first")
    fps = shared.stored(marked.groupBy("fp").agg(first))
    kept = shared.stored(rooted(fps).groupBy("c").agg(F.min("first").alias("first")).select("first.doc_id", "first.sum", "first.n")).alias("k")
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", total.alias("sum")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.sum") == F.col("k.sum"))
    joined = packed.join(kept.hint("merge"), same).select("_row", "d.doc_id", "d.sum", "n")
    again = joined.where("n > 1").dropDuplicates(["doc_id", "sum"])
    return joined.where("n = 1").select("_row.*").unionByName(again.select("_row.*"))


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    grouped = group(read(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
