"""LM scoring with a log-frequency Bloom filter.

Training counts words and word pairs of the training rows: each batch of texts counts its own, the sorted counts are dealt
by ranges of the gram's hash, and each range sums them and writes its block of the filter: a gram of count c has level 1 +
floor(log2 c) and is put in once for every level up to its own, so blocks hold quantised counts. Probing a gram's
levels upwards until one is missing gives its level back; a wrong one needs a false positive at each step.

The blocks are broadcast while they have FILTER_BYTES together, a bound that is checked on their sum. Beyond it they stay
where they are, and each batch asks them, in groups of neighbouring ranges with about GROUP_BYTES of blocks, for the levels of its
distinct words and pairs (the start mark's level is read once); both ways probe the same bits, so scores don't depend on
the filter's size.

The base score needs exact counts of all words, known to no single machine at scale: each batch's distinct words are joined
with the words' counts. A word of every text is one row a batch, and a join that adaptive execution can split. Words are known by
64-bit hashes; two of a billion distinct words share one with a probability of about 3 in 100.

A batch deals its counts to at most FAN places at once. With more ranges than that, FAN batches' counts of one place are summed
there first and dealt on from it, so what is shuffled grows with the data and not with its square.

P(w | h) = (min(c(hw), c(h)) + MU * (c(w) + 1) / (N + V + 1)) / (c(h) + MU), with quantised counts; a text begins after a
start mark and ends with one end token.

Defined results: null counts as empty (one token, the end); a null doc_id trains unless crc32 of the empty string says
otherwise; without training rows N and V are 0 and every probability is finite; repeated rows train and score as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

#: Bytes of text that are counted, and scored, at once.
COUNTED_BATCH = 8_000_000
BATCH = 5_000_000
#: Bytes of training text that one range of the hashes stands for.
RANGE = 8_000_000
FILTER_BYTES = 160_000_000
#: Bytes of blocks that one task answers from.
GROUP_BYTES = 64_000_000
#: Places that a batch deals its counts to at once.
FAN = 256
BITS, PROBES = 8, 5
LEVELS = 40
MU = 4.0
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"start of text", b"end of text"))
ODD = np.uint64(0x9E3779B97F4A7C15)
PACK, UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words and of the end token."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    return np.r_[np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64), END]


def pairs(ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token (START at the texts' first tokens) and the hash of the pair."""
    before = np.r_[START, ids[:-1]]
    before[firsts] = START
    return before, mixed(before * ODD + (ids ^ (ids >> np.uint64(31))))


def range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    """Which range a hash is in; rises with the hash."""
    return ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, plane by plane."""
    wide = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return PACK.compress(np.ascontiguousarray(wide.T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(UNPACK.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def gaps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


def slices(grams: np.ndarray, ranges: int, unit: int = 1):
    """(range, first, end) of the parts of sorted hashes, unit ranges being one."""
    places = range_of(grams, ranges) // unit
    cuts = np.flatnonzero(np.diff(places, prepend=-1, append=-1))
    return [(int(places[a]), int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def bits_of(grams: np.ndarray, level: int, size) -> list[np.ndarray]:
    """The bits, in a block of the given size, of grams at a level."""
    h = mixed(grams + np.array([level * 2 + 1], np.uint64) * ODD)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32) for i in range(PROBES)]


def block_of(grams: np.ndarray, counts: np.ndarray) -> bytes:
    level = np.floor(np.log2(counts.astype(np.float64))).astype(np.int64) + 1
    size = -(-max(1, int(level.sum())) * BITS // 64) * 64
    bits = np.zeros(size, bool)
    for k in range(1, min(LEVELS, int(level.max(initial=0))) + 1):
        for at in bits_of(grams[level >= k], k, np.uint64(size)):
            bits[at.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Blocks by range, in one array of bytes."""

    def __init__(self, blocks: dict[int, bytes], ranges: int):
        own = [blocks.get(r, bytes(8)) for r in range(ranges)]
        self.ranges, self.data = ranges, np.frombuffer(b"".join(own), np.uint8)
        self.size = np.array([8 * len(b) for b in own], np.uint64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]].astype(np.uint64)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.uint8)
        left = np.arange(len(grams))
        for level in range(1, LEVELS + 1):
            own = grams[left]
            r = range_of(own, self.ranges)
            start, there = self.start[r], np.ones(len(own), bool)
            for at in bits_of(own, level, self.size[r]):
                at = at + start
                there &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[there]
            if not len(left):
                break
            out[left] = level
        return out


def batched(batches, size: int = BATCH):
    """Runs of (doc_id, held_out, tokens) of about so many bytes of text, cut anywhere between texts."""
    held, total = [], 0
    for batch in batches:
        for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), shared.texts_of(batch.column("text")), strict=True):
            held.append((doc, out, tokens(text)))
            total += len(text) + 100
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def starts(held) -> np.ndarray:
    return np.r_[0, np.cumsum([len(t) for _, _, t in held])[:-1]].astype(np.int64)


WORD, PAIR, MARK = range(3)
COUNTED = "range long, batch long, kind long, grams binary, n binary"


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Rows of the columns of ddl, all long or binary."""
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.binary()) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def total(parts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and the sums of their counts."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    grams, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.add.reduceat(n, first)


def train(docs: DataFrame, ranges: int, batches: int = 1, fan: int = FAN) -> DataFrame:
    """A row per range: its words' hashes and counts, its block, and its numbers of tokens and words."""
    units = [1]
    while units[-1] * fan < ranges:
        units.append(units[-1] * fan)

    def sliced(kind, grams, n, batch, unit):
        return [(r, batch, kind, packed(gaps(grams[a:b])), packed(n[a:b])) for r, a, b in slices(grams, ranges, unit)]

    def count(rows):
        task = TaskContext.get().partitionId() << 32
        for k, held in enumerate(batched(rows, COUNTED_BATCH)):
            ids = np.concatenate([t for _, _, t in held])
            out = [x for kind, grams in ((WORD, ids), (PAIR, pairs(ids, starts(held))[1])) for x in sliced(kind, *np.unique(grams, return_counts=True), task + k, units[-1])]
            # One start mark a text, a word of the model but no token.
            yield batch_of(out + sliced(MARK, np.array([START]), np.array([len(held)]), task + k, units[-1]), COUNTED)

    def grouped(keys, close):
        """A function over rows sorted by keys: close(their values, counts by kind) gives each group's rows."""

        def run(rows):
            place, held = None, {}
            for part in rows:
                for *here, kind, grams, n in zip(*[part.column(c).to_pylist() for c in (*keys, "kind", "grams", "n")], strict=True):
                    if here != place:
                        if held:
                            yield close(place, held)
                        place, held = here, {}
                    held.setdefault(kind, []).append((np.cumsum(unpacked(grams)), unpacked(n)))
            if held:
                yield close(place, held)

        return run

    def passed_on(unit):
        return lambda place, held: batch_of([x for kind in sorted(held) for x in sliced(kind, *total(held[kind]), place[1], unit)], COUNTED)

    def finished(place, held):
        words, n = total(held.get(WORD, []))
        both, times = total([(words, n), total(held.get(PAIR, [])), total(held.get(MARK, []))])
        return batch_of([(place[0], packed(gaps(words)), packed(n), block_of(both, times), int(n.sum()), len(words))], MODEL)

    counted = docs.where("NOT held_out").mapInArrow(count, COUNTED)
    for unit in reversed(units[:-1]):
        batches = -(-batches // fan)
        joint = counted.withColumn("batch", F.pmod(F.xxhash64("batch"), F.lit(batches)))
        counted = joint.repartition(ranges, "range", "batch").sortWithinPartitions("range", "batch").mapInArrow(grouped(("range", "batch"), passed_on(unit)), COUNTED)
    return shared.stored(counted.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(grouped(("range",), finished), MODEL))


MODEL = "range long, words binary, n binary, block binary, n_tokens long, n_words long"
#: Kinds of rows about a batch, in the order in which they are taken: its texts, counts of its words, levels of pairs and of words.
TEXTS, COUNT, OF_PAIRS, OF_WORDS = range(4)
ASKED = "batch long, kind long, place long, n long, blob binary, docs binary"


def known_words(model: DataFrame) -> DataFrame:
    """gram and n: the training words' hashes and counts."""

    def run(batches):
        for part in batches:
            for grams, n in zip(part.column("words").to_pylist(), part.column("n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(unpacked(grams)).view(np.int64)), pa.array(unpacked(n).view(np.int64))], names=["gram", "n"])

    return model.select("words", "n").mapInArrow(run, "gram long, n long")


def asked(docs: DataFrame, groups: int) -> DataFrame:
    """Per batch: a row with its texts as places in its list of distinct words, a row per word, and per group of ranges (if any) what it asks for."""

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for k, held in enumerate(batched(batches)):
            ids = np.concatenate([t for _, _, t in held])
            words, place = np.unique(ids.view(np.int64), return_inverse=True)
            docs_ = pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in held], pa.int64()), pa.array([o for _, o, _ in held], pa.bool_()), pa.array([len(t) for _, _, t in held], pa.int64())], names=["doc_id", "held_out", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs_.schema) as out:
                out.write_batch(docs_)
            rows = [(task + k, TEXTS, 0, 0, packed(place), sink.getvalue().to_pybytes())]
            if groups:
                for kind, grams in ((OF_PAIRS, np.unique(pairs(ids, starts(held))[1])), (OF_WORDS, np.unique(ids))):
                    rows += [(task + k, kind, r, 0, packed(gaps(grams[a:b])), None) for r, a, b in slices(grams, groups)]
            yield batch_of(rows, ASKED)
            own = [pa.array(np.full(len(words), task + k)), pa.array(np.full(len(words), COUNT)), pa.array(words), pa.array(np.zeros(len(words), np.int64)), pa.nulls(len(words), pa.binary()), pa.nulls(len(words), pa.binary())]
            yield pa.RecordBatch.from_arrays(own, names=["batch", "kind", "place", "n", "blob", "docs"])

    return shared.stored(docs.mapInArrow(run, ASKED))


def levels_of(requests: DataFrame, model: DataFrame, ranges: int, groups: int) -> DataFrame:
    """The requests for levels, answered. A group of ranges is answered in one task, which holds the group's blocks."""
    blocks = model.select(F.lit(-1).cast("long").alias("batch"), F.col("range").alias("kind"), F.floor(F.col("range") * groups / ranges).alias("place"), F.lit(0).cast("long").alias("n"), F.col("block").alias("blob"), F.lit(None).cast("binary").alias("docs"))
    # A range that two groups share is known to both.
    last = F.floor((F.col("kind") * groups + groups - 1) / F.lit(ranges))
    blocks = blocks.select("batch", "kind", F.explode(F.sequence("place", last)).alias("place"), "n", "blob", "docs")

    def run(batches):
        place, held, known = None, {}, None
        for part in batches:
            rows = []
            for batch, kind, group, blob in zip(*[part.column(c).to_pylist() for c in ("batch", "kind", "place", "blob")], strict=True):
                if group != place:
                    place, held, known = group, {}, None
                if batch < 0:
                    held[kind] = blob
                else:
                    known = known or Filter(held, ranges)
                    rows.append((batch, kind, group, 0, packed(known.levels(np.cumsum(unpacked(blob)))), None))
            if rows:
                yield batch_of(rows, ASKED)

    dealt = blocks.union(requests.where(F.col("kind").isin(OF_PAIRS, OF_WORDS))).repartition(groups, "place").sortWithinPartitions("place", "batch")
    return dealt.mapInArrow(run, ASKED)


def in_parts(levels, grams: np.ndarray, size: int = 200_000) -> np.ndarray:
    """levels(grams), with the probes' arrays for a part of them at once."""
    return np.concatenate([np.empty(0, np.uint8), *[levels(grams[a : a + size]) for a in range(0, len(grams), size)]])


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that have a level."""
    return np.where(level > 0, (1.5 * 2.0 ** (level.astype(np.float64) - 1) - 0.5), 0.0)


def score(docs: DataFrame, filter_bytes: int = FILTER_BYTES, mu: float = MU, fan: int = FAN, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Of every row of docs (doc_id, held_out, text): n_tokens, n_known, train_tokens, base_score and score. Rows with held_out don't train."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, size // RANGE)
    model = train(docs, ranges, -(-size // COUNTED_BATCH), fan)
    n_tokens, n_words, filter_size = (x or 0 for x in model.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum(F.length("block"))).first())
    groups = max(2, filter_size // group_bytes) if filter_size > filter_bytes else 0
    shipped = start = None
    if groups:  # one block
        r = int(range_of(np.array([START]), ranges)[0])
        block = model.where(F.col("range") == r).select("block").first()
        start = Filter({r: bytes(block[0])} if block else {}, ranges).levels(np.array([START]))
    else:  # at most filter_bytes
        table = model.select("range", "block").toArrow()
        shipped = spark.sparkContext.broadcast(Filter(dict(zip(table.column("range").to_pylist(), table.column("block").to_pylist(), strict=True)), ranges))
    requests = asked(docs, groups)
    exact = requests.where(F.col("kind") == COUNT).select("batch", "place").join(known_words(model).withColumnRenamed("gram", "place"), "place", "left")
    none = F.lit(None).cast("binary")
    about = requests.where(F.col("kind") == TEXTS).union(exact.select("batch", F.lit(COUNT).cast("long").alias("kind"), "place", F.coalesce("n", F.lit(0)).alias("n"), none, none))
    if groups:
        about = about.union(levels_of(requests, model, ranges, groups))

    def run(batches):
        own, held = None, {}
        for part in batches:
            batch, kind = part.column("batch").to_numpy(), part.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(batch) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if batch[a] != own:
                    if held:
                        yield scored(held)
                    own, held = batch[a], {}
                held.setdefault(int(kind[a]), []).append(part.slice(a, b - a))
        if held:
            yield scored(held)

    def scored(held):
        column = lambda kind, c: [x for part in held.get(kind, []) for x in part.column(c).to_pylist()]
        numbers = lambda c: np.concatenate([part.column(c).to_numpy() for part in held[COUNT]])
        words, counts = numbers("place").view(np.uint64), numbers("n").astype(np.float64)
        place, texts = unpacked(column(TEXTS, "blob")[0]).astype(np.int64), pa.ipc.open_stream(column(TEXTS, "docs")[0]).read_all()
        n = texts.column("n").to_numpy()
        first = np.r_[0, np.cumsum(n)[:-1]]
        base = np.log10((counts + 1) / (n_tokens + n_words + 1))[place]
        before, grams = pairs(words[place], first)
        if groups:
            level = np.concatenate([unpacked(x) for x in column(OF_PAIRS, "blob")])[np.unique(grams, return_inverse=True)[1]]
            own, opening = np.empty(len(words), np.uint64), start
            own[np.argsort(words)] = np.concatenate([unpacked(x) for x in column(OF_WORDS, "blob")])
        else:
            known = shipped.value
            level, own, opening = in_parts(known.levels, grams), in_parts(known.levels, words), known.levels(np.array([START]))
        of_word = count_of(own)[place]
        of_before = np.r_[0.0, of_word[:-1]]
        of_before[first] = count_of(opening)[0]
        both = np.minimum(count_of(level), of_before)
        chance = (both + mu * (of_word + 1) / (n_tokens + n_words + 1)) / (of_before + mu)
        out = [texts.column("doc_id"), texts.column("held_out"), texts.column("n"), pa.array(np.add.reduceat((counts > 0)[place].astype(np.int64), first)), pa.array(np.full(len(n), n_tokens, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(chance), first))]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    together = about.repartition("batch").sortWithinPartitions("batch", "kind", "place")
    return together.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@query("op7_lm_score")
def op7_lm_score(spark, sf_dir):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score(read(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text"))
