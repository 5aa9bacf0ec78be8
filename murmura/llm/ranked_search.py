"""Ranked lexical search over a tiered index: high-impact postings first, lower tiers only where the proof of exactness fails.

The impact of a posting is the integer q = 10^9 tf div (1000 tf + 8 m), and a term's share of a score is w q. Per term, the
postings are cut by impact into tiers: the first holds about the N / 64 highest, the second about the N / 8 highest, the last
the rest. The index has a row per document and a pair of columns per tier (terms, impacts), so that a round that needs no lower
tier doesn't read it, and all postings of a document meet in one task without a shuffle. A term's residual bound below a tier is
w times the highest impact that lies below it.

A round scores all documents by the tiers so far, with a lower bound (what was seen) and an upper bound (plus the residuals of
the item's terms that were not). The tenth highest lower bound of an item, over all documents, is its bar. An item is proved
when a document of which nothing was seen can't reach the bar (the sum of its residuals is below it); the others fall through to
the next tier. In the last round the lower tiers of a document are added only for the items whose bar its upper bound reaches:
that is few documents for a proved item, and all documents for an item that fell through to the end. What is returned is exact.

Only terms that items ask for are indexed. Items are asked in blocks of at most PAIRS (item, term) pairs (or one item that alone
has more), whose tables go to the workers; each block is one index and its rounds. Tasks return their own best documents per
item, at least as good as the bar, and these few rows are ranked in two steps, within parts and then within the item.

Defined results: documents without terms (null, empty, signs only) aren't counted in N and are never returned. Rows of one
item_id are one item with the union of their terms; null is an item_id like any other. Rows of one doc_id are documents of their
own; equal scores rank by doc_id, null last, and rows that agree in both share their places in any order. Items without terms
return nothing; an empty table of documents or items gives no rows. Other columns, of whatever names, are not read. A long text
costs memory in proportion to its length.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

TOP = 10
#: The share of N that each tier but the last holds of a term's postings, at about.
TIERS = (1 / 64, 1 / 8)
#: (item, term) pairs of a block of items, whose tables each worker holds.
PAIRS = 200_000
#: Impacts are compared with tiers in this many steps of equal width.
STEPS = 256
MOST_IMPACT = 1_000_000
#: Scores that a task holds at once: items times documents.
CELLS = 1_000_000
#: Bytes of UTF-8: letters, digits and all beyond ASCII stay, A-Z become lower case, the rest parts terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
NULL_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each."""

    def run(batches):
        for batch in shared.parts(batches):
            own = [sorted(set(terms_of(t))) for t in shared.texts_of(batch.column("text"))]
            ids = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(ids), pa.array([t.decode() for x in own for t in x], pa.string())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term string").distinct()


class Block:
    """The items of a block: their numbers, and by term number (of terms in order) the items that ask for it."""

    def __init__(self, pairs: pa.Table):
        items, terms = pairs.column("item_id").to_pylist(), pairs.column("term").to_pylist()
        self.items = list(dict.fromkeys(items))
        self.terms = sorted(set(terms))
        number = {x: i for i, x in enumerate(self.items)}
        self.number = {t.encode(): i for i, t in enumerate(self.terms)}
        a = np.array([number[x] for x in items], np.int64)
        b = np.array([self.number[t.encode()] for t in terms], np.int64)
        order = np.lexsort((a, b))
        self.asking = a[order]
        self.start = np.searchsorted(b[order], np.arange(len(self.terms) + 1))


def blocks(pairs: DataFrame, room: int):
    """The items in blocks of at most room pairs; one item with more is a block of its own."""
    total, n = pairs.count(), 1
    while total:
        n = max(n, math.ceil(total / room))
        block = F.pmod(F.xxhash64("item_id", F.lit(n)), F.lit(n))
        sizes = pairs.groupBy(block.alias("block")).agg(F.count("*").alias("pairs"), F.countDistinct(F.coalesce(F.col("item_id"), F.lit(-1))).alias("items")).collect()
        if all(s["pairs"] <= room or s["items"] == 1 for s in sizes):
            for s in sorted(sizes, key=lambda s: s["block"]):
                yield Block(pairs.where(block == s["block"]).toArrow())
            return
        n *= 2


def forward(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers and occurrences of the terms that the block asks for, of documents with terms."""
    number = block.number

    def run(batches):
        for batch in shared.parts(batches):
            keep, sizes, terms, counts, width = [], [], [], [], [0]
            for i, text in enumerate(shared.texts_of(batch.column("text"))):
                own = terms_of(text)
                if not own:
                    continue
                keep.append(i)
                sizes.append(len(own))
                for t, c in Counter(own).items():
                    if (k := number.get(t)) is not None:
                        terms.append(k)
                        counts.append(c)
                width.append(len(terms))
            edge = pa.array(width, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(edge, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(edge, pa.array(counts, pa.int64()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def impacts(n: np.ndarray, counts: np.ndarray, size: np.ndarray, docs: int, words: int) -> np.ndarray:
    """q of each posting; n and size (postings of each document) are by document."""
    if len(n) and 90 * int(n.max()) * docs >= 2**63:
        m = np.array([10 + 90 * int(x) * docs // words for x in n], np.int64)
    else:
        m = 10 + 90 * n * docs // words
    return 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, size))


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def histogram(index: DataFrame, docs: int, words: int) -> DataFrame:
    """term, step, count and the highest impact of the postings of each step."""

    def run(batches):
        for batch in batches:
            terms, size = flat(batch, "terms")
            q = impacts(batch.column("n").to_numpy(), flat(batch, "counts")[0], size, docs, words)
            key, place, count = np.unique(terms.astype(np.int64) * STEPS + q * STEPS // (MOST_IMPACT + 1), return_inverse=True, return_counts=True)
            most = np.zeros(len(key), np.int64)
            np.maximum.at(most, place, q)
            yield pa.RecordBatch.from_arrays([pa.array(key // STEPS), pa.array(key % STEPS), pa.array(count.astype(np.int64)), pa.array(most)], names=["term", "step", "count", "most"])

    return index.mapInArrow(run, "term long, step long, count long, most long").groupBy("term", "step").agg(F.sum("count").alias("count"), F.max("most").alias("most"))


class Statistics:
    """Of a block: N, L, and by term its weight, the steps at which its tiers begin, and the residuals (w times impact) below each tier."""

    def __init__(self, steps: DataFrame, block: Block, docs: int, words: int, shares):
        self.docs, self.words = docs, words
        by = Window.partitionBy("term")
        above = F.sum("count").over(by.orderBy(F.desc("step")))  # postings of this step and higher ones
        cuts = []
        for k, share in enumerate(shares):
            inside = F.col("above") - F.col("count") < F.lit(max(1.0, share * docs))
            cuts += [F.min(F.when(inside, F.col("step"))).alias(f"from{k}"), F.coalesce(F.max(F.when(~inside, F.col("most"))), F.lit(0)).alias(f"below{k}")]
        rows = steps.withColumn("above", above).groupBy("term").agg(F.sum("count").alias("df"), *cuts).toArrow()  # a row per term of the block
        term = rows.column("term").to_numpy()
        self.weight = np.zeros(len(block.terms), np.int64)
        self.weight[term] = [math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in rows.column("df").to_pylist()]
        self.begin = np.zeros((len(shares), len(block.terms)), np.int64)
        self.residual = np.zeros((len(shares) + 1, len(block.terms)), np.int64)
        for k in range(len(shares)):
            self.begin[k, term] = rows.column(f"from{k}").to_numpy()
            self.residual[k, term] = rows.column(f"below{k}").to_numpy() * self.weight[term]


def tiered(index: DataFrame, stats: Statistics) -> DataFrame:
    """doc_id and, per tier k, terms<k> and impacts<k>. Terms of weight 0 add nothing and have no postings."""
    tiers = len(stats.begin) + 1

    def run(batches):
        for batch in batches:
            terms, size = flat(batch, "terms")
            q = impacts(batch.column("n").to_numpy(), flat(batch, "counts")[0], size, stats.docs, stats.words)
            tier = (q * STEPS // (MOST_IMPACT + 1) < stats.begin[:, terms]).sum(axis=0)
            doc = np.repeat(np.arange(len(size)), size)
            columns = [batch.column("doc_id")]
            for k in range(tiers):
                own = np.flatnonzero((tier == k) & (stats.weight[terms] > 0))
                edge = pa.array(np.r_[0, np.cumsum(np.bincount(doc[own], minlength=len(size)))].astype(np.int32))
                columns += [pa.ListArray.from_arrays(edge, pa.array(terms[own])), pa.ListArray.from_arrays(edge, pa.array(q[own].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=names(tiers))

    return index.mapInArrow(run, ", ".join(["doc_id long", *[f"terms{k} array<int>, impacts{k} array<int>" for k in range(tiers)]]))


def names(tiers: int) -> list[str]:
    return ["doc_id", *[f"{x}{k}" for k in range(tiers) for x in ("terms", "impacts")]]


class Best:
    """A task's best documents per item: at most top each, and none whose score is below the item's bar."""

    def __init__(self, bar: np.ndarray, top: int):
        self.bar, self.top = np.maximum(bar, 1), top
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: items x docs."""
        item, column = np.nonzero(scores >= self.bar[:, None])
        if not len(item):
            return
        item, score, doc = np.r_[self.item, item], np.r_[self.score, scores[item, column]], np.r_[self.doc, docs[column]]
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        last = place == self.top - 1
        self.bar[item[last]] = score[last]


def scored(index: DataFrame, block: Block, stats: Statistics, level: np.ndarray, bar: np.ndarray, tiers: int, top: int) -> DataFrame:
    """item (its number), doc_id and score: the best documents of each task.

    level: per item, the tier up to which all its postings are added (-1: the item isn't asked). Postings of later tiers, up to
    tiers - 1, are added where a document's upper bound reaches the item's bar; a document that can't reach it is left out. With
    tiers at an item's level + 1 the scores are lower bounds.
    """
    asking, start, weight = block.asking, block.start, stats.weight
    n = len(block.items)
    total = np.zeros(n, np.int64)  # of an item's residuals below its level
    owner = np.repeat(np.arange(len(weight)), np.diff(start))
    own_residual = np.where(level[asking] >= 0, stats.residual[level[asking], owner], 0)
    np.add.at(total, asking, own_residual)
    asked = np.flatnonzero(level >= 0)
    rank = np.zeros(n, np.int64)
    rank[asked] = np.arange(len(asked))

    def run(batches):
        best = Best(bar, top)
        for whole in batches:
            step = max(1, CELLS // max(1, len(asked)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                width = batch.num_rows
                sums, seen = np.zeros(len(asked) * width, np.int64), np.zeros(len(asked) * width, np.int64)
                later = []
                for k in range(tiers):
                    terms, size = flat(batch, f"terms{k}")
                    q = flat(batch, f"impacts{k}")[0].astype(np.int64)
                    fan = start[terms + 1] - start[terms]
                    pick = np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(start[terms], fan)
                    item = asking[pick]
                    cell = rank[item] * width + np.repeat(np.repeat(np.arange(width), size), fan)
                    value = np.repeat(q * weight[terms], fan)
                    now = level[item] >= k
                    np.add.at(sums, cell[now], value[now])
                    np.add.at(seen, cell[now], own_residual[pick[now]])
                    if tiers > 1:
                        wait = (level[item] >= 0) & ~now
                        later.append((cell[wait], value[wait]))
                if tiers - 1 > level[asked].min(initial=tiers):  # some postings wait for what the bounds say
                    upper = sums.reshape(len(asked), width) + total[asked][:, None] - seen.reshape(len(asked), width)
                    reach = (upper >= best.bar[asked][:, None]).ravel()
                    for cell, value in later:
                        ok = reach[cell]
                        np.add.at(sums, cell[ok], value[ok])
                    sums[~reach] = 0
                scores = np.zeros((n, width), np.int64)
                scores[asked] = sums.reshape(len(asked), width)
                best.add(scores, batch.column("doc_id").fill_null(NULL_LAST).to_numpy())
        doc = pa.array(best.doc, mask=best.doc == NULL_LAST)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), doc, pa.array(best.score)], names=["item", "doc_id", "score"])

    return index.select(*names(tiers)).mapInArrow(run, "item long, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """found with rank, the first top of each item; first within parts, so that no task meets all parts' rows of an item unranked."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = parts.withColumn("place", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("place") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def answered(docs: DataFrame, block: Block, top: int, shares) -> DataFrame:
    """item_id, rank, doc_id, score and tier (up to which the item's proof went) of one block."""
    spark = docs.sparkSession
    index = shared.stored(forward(docs, block))
    n, words = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")
    if not n:
        return empty
    stats = Statistics(shared.stored(histogram(index, n, words)), block, n, words, shares)
    index = shared.stored(tiered(index, stats))
    level, bar = np.zeros(len(block.items), np.int64), np.zeros(len(block.items), np.int64)
    owner = np.repeat(np.arange(len(block.terms)), np.diff(block.start))
    for k in range(len(shares)):
        open_ = level == k
        if not open_.any():
            break
        lower = ranked(scored(index, block, stats, np.where(open_, k, -1), bar, k + 1, top), top)
        for row in lower.where(F.col("rank") == top).collect():  # at most one row per item of the block
            bar[row["item"]] = max(bar[row["item"]], row["score"])
        unseen = np.zeros(len(block.items), np.int64)
        np.add.at(unseen, block.asking, stats.residual[k, owner])
        level[open_ & (unseen >= bar)] = k + 1
    found = ranked(scored(index, block, stats, level, bar, len(shares) + 1, top), top)
    items = spark.createDataFrame(pa.table({"item": pa.array(range(len(block.items)), pa.int64()), "item_id": pa.array(block.items, pa.int64()), "tier": pa.array(level, pa.int32())}))
    return found.join(F.broadcast(items), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "tier")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shares=TIERS, room: int = PAIRS) -> DataFrame:
    """The top documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score, tier."""
    out = None
    for block in blocks(shared.stored(item_terms(items)), room):
        own = answered(docs, block, top, shares)
        out = own if out is None else out.unionByName(own)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int") if out is None else out


ORACLE = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM documents
), postings AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY row),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, corpus GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (row), corpus GROUP BY ALL
), places AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM places WHERE rank <= 10
"""


@query("op11_ranked_search", ORACLE)
def op11_ranked_search(spark, sf_dir):
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("tier")
