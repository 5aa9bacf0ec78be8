"""Token times: words of a recognition with their times, and the stretch of time that each gap between reference words may have."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from murmura.functions import text as T

#: Punctuation, symbols and white space, but for line ends.
INNER = r"[\p{P}\p{S}\p{Z}\s&&[^\n]]"
LEAST, MOST = 0.2, 3.0


def lined(pieces: Column) -> Column:
    """pieces, one a line, with punctuation, symbols and white space in them as blanks."""
    joined = F.array_join(pieces, "\n")
    whole = F.length(joined) - F.length(F.replace(joined, F.lit("\n"), F.lit(""))) == F.size(pieces) - 1
    safe = F.when(whole, joined).otherwise(F.array_join(F.transform(pieces, lambda p: F.translate(F.coalesce(p, F.lit("")), "\n", " ")), "\n"))
    return F.regexp_replace(safe, INNER, " ")


class Lines:
    """Lines of words of a batch of texts, from their bytes: where words begin and end, and lines end, and the text of each."""

    def __init__(self, texts: pa.Array):
        raw, ends = T.pooled(texts)
        self.ends = ends + 1  # behind the line end after each text, which no word crosses
        word = (raw != 32) & (raw != 10)
        before = np.r_[False, word[:-1]]
        after = np.r_[word[1:], False]
        self.raw, self.starts, self.stops, self.lines = raw, np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1, np.flatnonzero(raw == 10)

    def words(self) -> pa.Array:
        """All words."""
        return T.cut(self.raw, self.starts, self.stops)


def sliced(*columns: pa.Array, rows: int = 1000):
    for at in range(0, len(columns[0]), rows):
        yield tuple(c.slice(at, rows) for c in columns)


def lists(counts: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.ListArray:
    """values in lists of these lengths."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values, mask=None if null is None or not len(counts) else pa.array(null))


@F.arrow_udf(ArrayType(IntegerType()))
def counted_lines(texts: pa.Array, sizes: pa.Array) -> pa.Array:
    """Numbers of words before each of a text's lines, and of all; a text of size 0 has no line."""
    out = [pa.array([], pa.list_(pa.int32()))]
    for text, size in sliced(texts, sizes):
        at = Lines(text)
        before = np.searchsorted(at.starts, at.lines)  # words up to each line's end
        n = size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.searchsorted(at.lines, at.ends - 1)  # the line that ends each text
        first = np.r_[0, last[:-1] + 1] if len(last) else last
        base = np.r_[0, before[last[:-1]]] if len(last) else last
        count = np.where(n > 0, last - first + 1, 0)
        own = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        values = np.zeros(int(count.sum()) + len(n), np.int32)
        there = np.ones(len(values), bool)
        there[np.cumsum(count + 1) - count - 1] = False
        values[there] = before[own] - np.repeat(base, count)
        out.append(lists(count + 1, pa.array(values), text.is_null().to_numpy(zero_copy_only=False)))
    return pa.concat_arrays(out)


def gap_map(raw: Column) -> Column:
    """For each gap of raw words, first to last, the number of normalised words before it."""
    return counted_lines(lined(raw), F.size(raw))


GROUPED = StructType([StructField("text", StringType()), StructField("start", ArrayType(DoubleType())), StructField("last_start", ArrayType(DoubleType()))])
TIMED = StructType([StructField("text", StringType()), StructField("start", DoubleType()), StructField("last_start", DoubleType())])


@F.arrow_udf(GROUPED)
def grouped_tokens(tokens: pa.Array, times: pa.Array) -> pa.Array:
    """Words that tokens are joined to, one a line, with the times of each one's first and last token."""
    out = []
    for own, at in sliced(tokens, times):
        size = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces, time = own.flatten().fill_null(""), at.flatten()
        opens = pc.or_(pc.starts_with(pieces, " "), pc.starts_with(pieces, "▁")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        opens[(ends - size)[size > 0]] = True
        starts = np.flatnonzero(opens)
        groups = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(pieces)].astype(np.int32)), pc.replace_substring(pc.utf8_ltrim(pieces, " ▁"), "\n", " "))
        words = pc.binary_join(groups, "")
        count = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - size)
        null = own.is_null().to_numpy(zero_copy_only=False)
        edge = [lists(count, time.take(pa.array(x)), null) for x in (starts, np.r_[starts[1:], len(pieces)][: len(starts)] - 1)]
        out.append(pa.StructArray.from_arrays([pc.binary_join(lists(count, words, null), "\n"), *edge], names=["text", "start", "last_start"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("text", pa.string()), ("start", pa.list_(pa.float64())), ("last_start", pa.list_(pa.float64()))]))


@F.arrow_udf(ArrayType(TIMED))
def timed_lines(texts: pa.Array, starts: pa.Array, lasts: pa.Array) -> pa.Array:
    """The words of texts, each with the times of its line."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.float64()), ("last_start", pa.float64())]))
    out = [pa.array([], kind)]
    for text, start, last in sliced(texts, starts, lasts):
        at = Lines(text)
        owner = np.searchsorted(at.ends - 1, at.starts, "right")  # the text of each word
        line = np.searchsorted(at.lines, at.starts)
        first = np.r_[0, np.searchsorted(at.lines, at.ends - 1)[:-1] + 1] if len(text) else np.zeros(0, np.int64)
        size = start.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        place = pa.array((np.cumsum(size) - size)[owner] + line - first[owner])
        rows = pa.StructArray.from_arrays([at.words(), start.flatten().take(place), last.flatten().take(place)], names=["text", "start", "last_start"])
        out.append(lists(np.bincount(owner, minlength=len(text)), rows, text.is_null().to_numpy(zero_copy_only=False)).cast(kind))
    return pa.concat_arrays(out)


def token_words(tokens: Column, times: Column) -> Column:
    """array<struct<text, start, last_start>>: tokens joined to words at word starts, then normalised to 0, 1 or more words each.

    Null if there are no tokens or not one time for each.
    """
    usable = (F.size(tokens) > 0) & (F.size(tokens) == F.size(times))
    joined = grouped_tokens(F.when(usable, tokens), F.when(usable, times.cast("array<double>")))
    return timed_lines(F.regexp_replace(F.lower(joined["text"]), INNER, " "), joined["start"], joined["last_start"])


def spans(count: np.ndarray, owner, i, j, there: np.ndarray, start, last, end, least, most) -> tuple:
    """Row, gap, t0, t1, widened and valid of the windows of all gaps of rows, as gap_windows() says.

    count: gaps of each row; owner, i and j: row, place in the reference and place in the recognition of each pair; there: recognised words of
    each row, whose times start and last are; end, least and most: duration and lengths for each row, or one for all.
    """
    base = np.cumsum(count) - count
    row = np.repeat(np.arange(len(count)), count)
    gap = np.arange(len(row)) - base[row]
    first = np.cumsum(there) - there
    at = base[owner] + i
    made = [np.full(len(row), np.nan), np.full(len(row), np.nan)]
    inside = (j >= 0) & (j < there[owner])
    for values, times in zip((start, last), made, strict=True):
        times[at[inside]] = values[first[owner[inside]] + j[inside]]
    start, last = made
    mark, none = np.full(len(row), -1), len(row)
    mark[at] = at
    prev = np.r_[-1, np.maximum.accumulate(mark)[:-1]] if len(row) else mark
    behind = np.full(len(row), none)
    behind[at] = at
    next_ = np.minimum.accumulate(behind[::-1])[::-1]
    no_prev, no_next = prev < base[row], next_ >= (base + count)[row]
    end, least, most = (x[row] if isinstance(x, np.ndarray) else x for x in (end, least, most))
    t0 = np.where(no_prev, np.nan, last[np.maximum(prev, 0)])
    t0 = np.where(np.isnan(t0), 0.0, t0)
    t1 = np.where(no_next, np.nan, start[np.minimum(next_, max(0, none - 1))])
    t1 = np.fmax(t0, np.where(np.isnan(t1), end, t1))
    widened = (gap > 0) & (no_prev | (prev != base[row] + gap - 1)) | (gap < count[row] - 1) & (no_next | (next_ != base[row] + gap))
    t1 = np.where(t1 - t0 < least, np.fmin(end, t0 + least), t1)
    t0 = np.where(t1 - t0 < least, np.fmax(0.0, t1 - least), t0)
    return row, gap, t0, t1, widened, ~(no_prev & no_next) & (t1 - t0 <= most)


TOTALS = "gap int, n long, widened long, t0 double, t1 double"


def totals(parts, least: float = LEAST, most: float = MOST):
    """Batches of TOTALS of the valid windows of parts (spans()' arguments up to end): by gap how many there are, how many are widened, and the sums of their ends."""
    for part in parts:
        _, gap, t0, t1, widened, valid = spans(*part, least, most)
        own = gap[valid]
        sums = [np.bincount(own), *(np.bincount(own, x[valid]) for x in (widened, t0, t1))]
        there = np.flatnonzero(sums[0])
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *[pa.array(x[there]).cast(k) for x, k in zip(sums, kinds, strict=True)]], names=["gap", "n", "widened", "t0", "t1"])


@F.arrow_udf(ArrayType(StructType([StructField("gap", IntegerType()), *[StructField(c, DoubleType()) for c in ("t0", "t1")], *[StructField(c, BooleanType()) for c in ("widened", "valid")]])))
def windows_of(n_ref: pa.Array, pairs: pa.Array, heard: pa.Array, duration: pa.Array, least: pa.Array, most: pa.Array) -> pa.Array:
    """The windows of all gaps of each row, as gap_windows() says."""
    kind = pa.list_(pa.struct([("gap", pa.int32()), ("t0", pa.float64()), ("t1", pa.float64()), ("widened", pa.bool_()), ("valid", pa.bool_())]))
    out = [pa.array([], kind)]
    for n, pair, word, length, low, high in sliced(n_ref, pairs, heard, duration, least, most):
        null = n.is_null().to_numpy(zero_copy_only=False)
        count = np.where(null, 0, n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        # The recognised word at each place of the reference.
        size = pair.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        owner, (i, j) = np.repeat(np.arange(len(n)), size), pair.flatten().flatten()
        both = i.is_valid().to_numpy(zero_copy_only=False) & j.is_valid().to_numpy(zero_copy_only=False) & ~null[owner]
        owner, i, j = owner[both], *(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[both] for x in (i, j))
        there = word.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        times = [pc.struct_field(word.flatten(), c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("start", "last_start")]
        end = length.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        _, gap, t0, t1, widened, valid = spans(count, owner, i, j, there, *times, end, *(x.to_numpy(zero_copy_only=False) for x in (low, high)))
        rows = pa.StructArray.from_arrays([pa.array(gap.astype(np.int32)), *[pa.array(x, mask=~valid) for x in (t0, t1, widened)], pa.array(valid)], names=["gap", "t0", "t1", "widened", "valid"])
        out.append(lists(count, rows, null).cast(kind))
    return pa.concat_arrays(out)


def windows(least: float = LEAST, most: float = MOST) -> Column:
    """array<struct<gap, t0, t1, widened, valid>> of a row's n_ref, pairs, heard and duration."""
    return windows_of("n_ref", "pairs", "heard", "duration", F.lit(least), F.lit(most))


def gap_windows(rows: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """sample_id, gap, t0, t1, widened and valid of every gap of rows (sample_id, n_ref, pairs, heard, duration).

    pairs is the alignment of reference and recognised words, heard the latter's times. A gap reaches from the last
    start of the nearest aligned word before it (0 without one) to the start of the nearest behind it (duration without one); it is widened
    if one of them is not its neighbour, and grown to the least length, to the right and then to the left. It is not
    valid (and has no times) without any aligned word, or beyond the longest length.
    """
    return rows.select("sample_id", windows(least, most).alias("_w")).select("sample_id", F.inline("_w"))


def centre(t0: Column, t1: Column) -> Column:
    return (t0 + t1) / 2
