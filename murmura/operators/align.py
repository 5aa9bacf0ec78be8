"""Word alignment: least edit paths of whole batches of utterances at once, and word error rates made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from murmura.functions import text as T
from murmura.operators import stats

#: Cells of the cost tables that are in memory at once; a pair with more is aligned in pieces.
CELLS = 8_000_000
#: Words of a reference whose column of differences is one number.
BITS = 64
#: Cells of a pair's table from which on it is aligned by waves.
LONG = 1_000_000


def codes(ref: pa.ListArray, hyp: pa.ListArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The words of both sides as whole numbers, equal for equal words of the batch."""
    both = pa.concat_arrays([ref.flatten(), hyp.flatten()])
    numbers = both.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    sizes = np.r_[ref.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), hyp.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]
    parts = np.split(numbers, np.cumsum(sizes)[:-1])
    return parts[: len(ref)], parts[len(ref) :]


def padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows), default=0)), fill, np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def cost_tables(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """pairs x (n + 1) x (m + 1) edit distances of prefixes. Row by row for all pairs: a running minimum does for insertions."""
    (count, n), m = a.shape, b.shape[1]
    slope = np.arange(m + 1, dtype=np.int32)
    table = np.empty((count, n + 1, m + 1), np.int32)
    table[:, 0] = slope
    for i in range(n):
        above, row = table[:, i], table[:, i + 1]
        np.add(above, 1, out=row)
        np.minimum(row[:, 1:], above[:, :-1] + (a[:, i, None] != b), out=row[:, 1:])
        row -= slope
        np.minimum.accumulate(row, axis=1, out=row)
        row += slope
    return table


def paths(ref: list[np.ndarray], hyp: list[np.ndarray]):
    """Of each pair, the steps of a least path: (step of the walk, pair, i, j), i or j being -1 where a side has no word.

    The walk goes back from the ends for all pairs at once. Fixed rule for ties: a match or substitution before a
    deletion, that before an insertion.
    """
    a, b = padded(ref, -1), padded(hyp, -2)
    table = cost_tables(a, b)
    i, j = np.array([len(x) for x in ref]), np.array([len(x) for x in hyp])
    own, out = np.arange(len(ref)), []
    while len(own):
        left = (i[own] > 0) | (j[own] > 0)
        own = own[left]
        if not len(own):
            break
        x, y = i[own], j[own]
        here, up, back = table[own, x, y], np.maximum(x - 1, 0), np.maximum(y - 1, 0)
        inside = (x > 0) & (y > 0)
        if a.shape[1] and b.shape[1]:
            both = inside & (here == table[own, up, back] + (a[own, up] != b[own, back]))
        else:
            both = np.zeros(len(own), bool)
        gone = ~both & (x > 0) & (here == table[own, up, y] + 1)
        out.append((own, np.where(both | gone, up, -1), np.where(gone, -1, back)))
        i[own] = np.where(both | gone, up, x)
        j[own] = np.where(gone, y, back)
    return out


def by_size(ref, hyp):
    """Places of pairs in groups of like size whose tables fit into CELLS together."""
    n, m = np.array([len(x) for x in ref]), np.array([len(x) for x in hyp])
    order, group, high = np.lexsort((m, n)), [], [0, 0]
    for k in order.tolist():
        high_ = [max(high[0], n[k] + 1), max(high[1], m[k] + 1)]
        if group and (len(group) + 1) * high_[0] * high_[1] > CELLS:
            yield group
            group, high_ = [], [n[k] + 1, m[k] + 1]
        group.append(k)
        high = high_
    if group:
        yield group


def crossing(a: np.ndarray, b: np.ndarray) -> int:
    """Where the path that paths() gives for a and b enters the middle row of a, in memory of one row.

    Costs go row by row. From the middle row on, each cell also keeps where its own path, by the rule for ties, has left that row.
    """
    m, middle = len(b), len(a) // 2
    slope = np.arange(m + 1, dtype=np.int32)
    above, left_at = slope.copy(), slope.copy()
    for i in range(len(a)):
        both = above[:-1] + (b != a[i])
        row = above + 1
        np.minimum(row[1:], both, out=row[1:])
        row -= slope
        np.minimum.accumulate(row, out=row)
        row += slope
        if i >= middle:
            diagonal = row[1:] == both
            own = left_at.copy()
            own[1:][diagonal] = left_at[:-1][diagonal]
            kept = np.r_[True, diagonal | (row[1:] == above[1:] + 1)]  # the others come from their left neighbour
            left_at = own[np.maximum.accumulate(np.where(kept, slope, 0))]
        above = row
    return int(left_at[m])


def pieces(a: np.ndarray, b: np.ndarray, cells: int) -> list[tuple[int, int, int, int]]:
    """a and b as stretches (from and to in a, from and to in b), in order, whose own paths make up the path of the whole, each of at most cells.

    The part of a path above its crossing of the middle row is the path of what lies above, and so below it: the rule for ties looks
    at differences of costs only, and along the path these are the same in the whole and in its parts.
    """
    todo, out = [(0, len(a), 0, len(b))], []
    while todo:
        i, n, j, m = todo.pop()
        if (n - i + 1) * (m - j + 1) <= cells or n - i < 2:
            out.append((i, n, j, m))
            continue
        middle, at = i + (n - i) // 2, j + crossing(a[i:n], b[j:m])
        todo += [(middle, n, at, m), (i, middle, j, at)]
    return out


def doubled(a: np.ndarray, b: np.ndarray, levels: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For stretches of 1, 2, 4, ... words, a number for the stretch at each place of a and of b, equal for equal stretches; those over an end equal none."""
    out = [(np.r_[a, -1], np.r_[b, -2])]
    for level in range(1, levels):
        half = 1 << (level - 1)
        both = []
        for x in out[-1]:
            later = np.full(len(x), -1, np.int64)
            later[: max(0, len(x) - half)] = x[half:]
            both.append(np.where((x >= 0) & (later >= 0), x.astype(np.int64) << 32 | np.maximum(later, 0), -1))
        _, number = np.unique(np.concatenate(both), return_inverse=True)
        left, right = number[: len(both[0])], number[len(both[0]) :]
        out.append((np.where(both[0] >= 0, left, -1), np.where(both[1] >= 0, right, -2)))
    return out


def waves(a: np.ndarray, b: np.ndarray, most: int) -> tuple[list[np.ndarray], list[int]] | None:
    """For costs 0, 1, 2, ... how far down a each diagonal (i - j) is reached at that cost, up to the cost of the whole; None if that takes more than most numbers.

    Costs never fall along a diagonal, so a cell's cost is the first wave that reaches it.
    """
    n, m = len(a), len(b)
    levels = doubled(a, b)
    out, lows, held = [], [], 0
    low, at = 0, np.zeros(1, np.int64)
    while True:
        k = np.arange(low, low + len(at))
        go = np.flatnonzero((at >= 0) & (levels[0][0][np.maximum(at, 0)] == levels[0][1][np.clip(at - k, 0, m)]))
        if len(go):
            i, d = at[go] + 1, k[go]
            (far_a, far_b), step = levels[-1], 1 << (len(levels) - 1)
            on = np.arange(len(go))
            while len(on):
                on = on[far_a[i[on]] == far_b[i[on] - d[on]]]
                i[on] += step
            for level in range(len(levels) - 2, -1, -1):
                i += (levels[level][0][i] == levels[level][1][i - d]).astype(np.int64) << level
            at[go] = i
        out.append(at)
        lows.append(low)
        held += len(at)
        if low <= n - m < low + len(at) and at[n - m - low] >= n:
            return out, lows
        if held > most:
            return None
        first, last = max(low - 1, -m), min(low + len(at), n)
        wide = np.full(len(at) + 4, -2 * (n + m) - 4, np.int64)
        wide[2:-2] = at
        near = np.maximum(np.maximum(wide[1:-1] + 1, wide[:-2] + 1), wide[2:])  # a substitution, a deletion, an insertion
        near = near[first - (low - 1) : last - (low - 1) + 1]
        at = np.minimum(np.minimum(near, n), m + np.arange(first, last + 1))
        low = first


def traced(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The steps of the path that paths() gives for a and b, from its end, in time and memory of the square of its cost; None beyond most numbers."""
    found = waves(a, b, most)
    if found is None:
        return None
    reached, lows = found
    x, y, i, j, e, out = a.tolist(), b.tolist(), len(a), len(b), len(reached) - 1, []

    def reaches(e, i, j):
        place = i - j - lows[e]
        return 0 <= place < len(reached[e]) and reached[e][place] >= i

    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
            continue
        e -= 1
        if i and j and reaches(e, i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and reaches(e, i - 1, j):
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    steps = np.array(out, np.int64).reshape(-1, 2)
    return steps[:, 0], steps[:, 1]


def walked(ref: pa.ListArray, hyp: pa.ListArray, cells: int = CELLS, long: int = LONG):
    """pair, i and j of all steps of all paths, and an order that puts them by pair, each from its end to its start.

    A pair whose table has more than long cells is aligned by waves; where these would take more than cells numbers and the table has more cells than that,
    it is cut into pieces, so memory grows with its length, not with the table.
    """
    a, b = codes(ref, hyp)
    own, cut = [], []
    steps, order = [(np.empty(0, np.int64),) * 3], [np.empty(0, np.int64)]
    for k in range(len(a)):
        size = (len(a[k]) + 1) * (len(b[k]) + 1)
        path = traced(a[k], b[k], min(cells, size)) if size > long else None
        if path is not None:
            steps.append((np.full(len(path[0]), k), *path))
            order.append(np.arange(len(path[0])))
            continue
        parts = pieces(a[k], b[k], cells) if size > cells else [(0, len(a[k]), 0, len(b[k]))]
        own += [k] * len(parts)
        cut += parts
    left, right = [a[k][i:n] for k, (i, n, _, _) in zip(own, cut, strict=True)], [b[k][j:m] for k, (_, _, j, m) in zip(own, cut, strict=True)]
    owner = np.array(own, np.int64)
    start_i, start_j = (np.array([c[x] for c in cut], np.int64) for x in (0, 2))
    reach = max((len(x) + len(y) for x, y in zip(a, b, strict=True)), default=0) + 1
    for group in by_size(left, right):
        places = np.array(group)
        for turn, (part, i, j) in enumerate(paths([left[k] for k in group], [right[k] for k in group])):
            at = places[part]
            steps.append((owner[at], np.where(i >= 0, i + start_i[at], -1), np.where(j >= 0, j + start_j[at], -1)))
            order.append((len(own) - at) * reach + turn)  # a pair's last piece first
    pair, i, j = (np.concatenate(x) for x in zip(*steps, strict=True))
    return pair, i, j, a, b, np.lexsort((np.concatenate(order), pair))


def slices(*sides: pa.ListArray, most: int = 100_000):
    """Both sides in stretches of rows that have so many words (or one row), so that tables and paths of a few rows are in memory at once."""
    ends, at = np.cumsum(sum(s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for s in sides)), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield tuple(s.slice(at, to - at) for s in sides)
        at = to


def stepwise(ref: pa.ListArray, hyp: pa.ListArray) -> np.ndarray:
    """Substitutions, deletions and insertions of each pair, counted on its path."""
    pair, i, j, a, b, _ = walked(ref, hyp)
    starts = [np.r_[0, np.cumsum([len(x) for x in s])[:-1]].astype(np.int64) for s in (a, b)]
    both = (i >= 0) & (j >= 0)
    left, right = (np.concatenate([*s, [-1]]) for s in (a, b))
    other = both.copy()
    other[both] = left[starts[0][pair[both]] + i[both]] != right[starts[1][pair[both]] + j[both]]
    return np.array([np.bincount(pair[mask], minlength=len(a)) for mask in (other, j < 0, i < 0)])


def bitwise(ref: pa.ListArray, hyp: pa.ListArray, both_sides: list | None = None) -> np.ndarray:
    """The same for references of at most BITS words: a column of a pair's table is a few numbers whose bits are the differences of its costs (Myers, Hyyrö).

    both_sides, if given, is filled with the steps that have a word on both sides: arrays of pairs, places in ref and in hyp.
    """
    both = pa.concat_arrays([ref.flatten(), hyp.flatten()])
    word = both.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    n, m = (s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for s in (ref, hyp))
    start = np.cumsum(m) - m
    pair = np.repeat(np.arange(len(n)), n)
    key = pair * (len(both) + 1) + word[: len(pair)]
    known, number = np.unique(key, return_inverse=True)
    places = np.zeros(len(known) + 1, np.uint64)
    np.bitwise_or.at(places, number, np.uint64(1) << (np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64))
    key = np.repeat(np.arange(len(m)), m) * (len(both) + 1) + word[len(pair) :]
    at = np.searchsorted(known, key)
    equal = np.where(np.r_[known, -1][at] == key, places[at], np.uint64(0))  # of each word of hyp, its places in ref
    # Words of hyp, one after the other, for all pairs that have so many: the longest come first.
    order = np.argsort(-m, kind="stable")
    having = np.searchsorted(-m[order], -np.arange(m.max(initial=0)), "left")
    one = np.uint64(1)
    up, down = np.full(len(m), ~np.uint64(0)), np.zeros(len(m), np.uint64)
    changed, gone = np.empty_like(equal), np.empty_like(equal)
    for j, count in enumerate(having.tolist()):
        here = start[order[:count]] + j
        e, vp, vn = equal[here], up[:count], down[:count]
        x = e | vn
        d = ((vp + (x & vp)) ^ vp) | x  # no dearer than what lies across
        hn, hp = vp & d, vn | ~(vp | d)
        x = (hp << one) | one
        up[:count], down[:count] = (hn << one) | ~(x | d), x & d
        changed[here] = d & ~e  # neither a match nor a substitution
        gone[here] = up[:count]  # dearer than what lies above
    # Back from the ends, as paths() goes.
    i, j, out = n.copy(), m.copy(), np.zeros((3, len(n)), np.int64)
    own = np.flatnonzero((i > 0) & (j > 0))
    while len(own):
        x, y = i[own], start[own] + j[own] - 1
        bit = one << (x - 1).astype(np.uint64)
        off = (changed[y] & bit) != 0
        deleted = off & ((gone[y] & bit) != 0)
        inserted = off & ~deleted
        if both_sides is not None:
            both_sides.append((own[~off], x[~off] - 1, j[own[~off]] - 1))
        out[0, own] += ~off & ((equal[y] & bit) == 0)
        out[1, own] += deleted
        out[2, own] += inserted
        i[own] -= ~inserted
        j[own] -= ~deleted
        own = own[(i[own] > 0) & (j[own] > 0)]
    out[1] += i
    out[2] += j
    return out


def matched(ref: pa.ListArray, hyp: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, place in ref and place in hyp of the steps of the least paths that have a word on both sides."""
    n, m = (s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for s in (ref, hyp))
    short = (n <= BITS) & ((n + 1) * (m + 1) <= LONG)
    out = [(np.empty(0, np.int64),) * 3]
    for mask, of in ((short, bitwise), (~short, walked)):
        rows, at = np.flatnonzero(mask), 0
        for one in slices(*(s.take(pa.array(rows)) for s in (ref, hyp))):
            steps = []
            if of is bitwise:
                bitwise(*one, steps)
            else:
                pair, i, j = walked(*one)[:3]
                steps.append(tuple(x[(i >= 0) & (j >= 0)] for x in (pair, i, j)))
            out += [(rows[at + pair], i, j) for pair, i, j in steps]
            at += len(one[0])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


EDITS = StructType([StructField(k, LongType()) for k in ("sub", "del", "ins")])


@F.arrow_udf(EDITS)
def edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Substitutions, deletions and insertions of the least path of each pair of arrays of words; null counts as empty."""
    counts = [np.zeros((3, 0), np.int64)]
    for one in slices(ref, hyp):
        n, m = (s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for s in one)
        short = (n <= BITS) & ((n + 1) * (m + 1) <= LONG)
        own = np.zeros((3, len(n)), np.int64)
        for mask, count in ((short, bitwise), (~short, stepwise)):
            if mask.any():
                own[:, mask] = count(*(s.filter(pa.array(mask)) for s in one))
        counts.append(own)
    return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(counts, axis=1)], names=["sub", "del", "ins"])


@F.arrow_udf(StructType([*EDITS, *[StructField(k, LongType()) for k in ("ref_words", "hyp_words")]]))
def sized_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """edits() and how many words both sides have."""
    sizes = [s.value_lengths().fill_null(0).cast(pa.int64()) for s in (ref, hyp)]
    return pa.StructArray.from_arrays([*edits.func(ref, hyp).flatten(), *sizes], names=["sub", "del", "ins", "ref_words", "hyp_words"])


@F.pandas_udf(EDITS)
def edit_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """The same of pandas columns."""
    sides = [pa.array([None if x is None else list(x) for x in s], pa.list_(pa.string())) for s in (ref, hyp)]
    return pd.DataFrame({k: x.to_numpy() for k, x in zip(("sub", "del", "ins"), edits.func(*sides).flatten(), strict=True)})


STEPS = pa.list_(pa.struct([pa.field(k, pa.int32()) for k in "ij"]))


@F.arrow_udf(ArrayType(StructType([StructField(k, IntegerType()) for k in "ij"])))
def aligned(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The least path of each pair of arrays of words: places in both, null where a side has no word."""
    out = [pa.array([], STEPS)]
    for one in slices(ref, hyp):
        pair, i, j, a, _, order = walked(*one)
        order = order[np.lexsort((-np.arange(len(order)), pair[order]))]  # from start to end
        sides = pa.StructArray.from_arrays([pa.array(x[order].astype(np.int32), mask=x[order] < 0) for x in (i, j)], names=["i", "j"])
        out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(pair[order], np.arange(len(a) + 1)).astype(np.int32)), sides).cast(STEPS))
    return pa.concat_arrays(out)


def rated(spoken: DataFrame, recognised: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of every row of spoken (keys, text) against recognised (keys, text, error): no row is lost.

    A row without recognition has the error missing_asr_record, a failed one keeps its error.
    """
    heard = recognised.select(*keys, F.col("text").alias("heard"), F.col("error"), F.lit(True).alias("_there"))
    joined = spoken.join(heard, keys, "left")
    return rated_pairs(joined.withColumn("error", F.when(F.col("_there").isNull(), "missing_asr_record").otherwise(F.col("error"))).drop("_there"))


def rated_pairs(rows: DataFrame) -> DataFrame:
    """rows (text, heard, error and others) with their errors in place of both texts, which are normalised first.

    A row with an error has no numbers. An empty reference has a null wer, but its errors count.
    """
    good = F.col("error").isNull()
    clean = lambda c: T.normalized_words(T.nfc(F.when(good, F.coalesce(F.col(c), F.lit("")))))
    counted = rows.withColumn("_x", sized_edits(clean("text"), clean("heard")))  # arrays of words go to Python without being in a row
    own = [F.when(good, F.col(f"_x.{c}")) for c in ("ref_words", "hyp_words", "sub", "del", "ins")]
    named = [c.cast("long").alias(n) for c, n in zip(own, ("ref_words", "hyp_words", "sub", "del", "ins"), strict=True)]
    digits = F.when(good, F.coalesce(F.col("heard"), F.lit("")).rlike(T.digit())).alias("hyp_has_digits")
    out = counted.select(*[c for c in rows.columns if c not in ("text", "heard", "error")], *named, digits, "error")
    out = out.withColumn("errors", F.col("sub") + F.col("del") + F.col("ins"))
    return out.withColumn("wer", F.try_divide(F.col("errors").cast("double"), F.col("ref_words")))


def corpus_rate(errors: Column, words: Column) -> Column:
    return F.try_divide(F.sum(errors).cast("double"), F.sum(words))


def intervals(rows: DataFrame, by: list[str] = [], speaker: str = "speaker", reps: int = 500, seed: int = 0) -> DataFrame:  # noqa: B006
    """The corpus error rate of rated rows (with key, which tells them apart), by groups if wanted, with intervals over rows and over speakers."""
    good = rows.where("error IS NULL").select(*by, "key", F.col("errors").alias("num"), F.col("ref_words").alias("den"), speaker)
    return stats.intervals(good, by, speaker, reps, seed)


def summarised(rows: DataFrame, speaker: str = "speaker") -> DataFrame:
    """One row: corpus, mean and macro error rates, S, D, I, samples, failures and samples with digits."""
    by = rows.groupBy(speaker).agg(
        *[F.sum(c).alias(c) for c in ("errors", "ref_words", "sub", "del", "ins", "wer")], F.count("wer").alias("rated"), F.count("*").alias("n"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if("hyp_has_digits").alias("digits"),
    )
    macro = F.avg(F.try_divide(F.col("errors").cast("double"), F.col("ref_words")))
    return by.agg(
        corpus_rate(F.col("errors"), F.col("ref_words")).alias("corpus"), F.try_divide(F.sum("wer"), F.sum("rated")).alias("mean"), macro.alias("macro"),
        *[F.sum(c).alias(c) for c in ("sub", "del", "ins")], F.sum("n").alias("n_samples"), F.sum("failed").alias("n_failed"), F.sum("digits").alias("n_hyp_with_digits"),
    )
