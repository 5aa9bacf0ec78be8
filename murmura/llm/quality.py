"""Quality rules with risk-controlled thresholds.

Each rule compares one ratio of a text with a cutoff. Cutoffs are fitted per stratum (the language) on the labelled
documents, as a holdout: a cutoff is certified if the exact binomial test rejects "this rule turns away more than
ALPHA / rules of the good documents". Within a stratum and rule the cutoffs are tested from the mildest to the sharpest
and testing stops at the first that fails (fixed-sequence testing, which needs no correction); over strata and rules
the error DELTA is divided by their number (Bonferroni). All certified cutoffs hold at once, so any choice among them is
valid: the one is taken that turns away most bad documents, a share of good ones weighing GOOD_WEIGHT times as much. A
stratum with too few labels certifies nothing and keeps all that passes the base rules.

Counts per stratum, rule, step and label are summed with map-side combine; what meets in one task is one stratum's
histogram (rules x steps x 2 rows). Texts never move: features are computed where a text is read.

Defined results: null text counts as empty (it fails the base rules); null language is a stratum of its own; several labels of one
document count as one, good if any is; labels of unknown documents and null labels are ignored; without labels every rule is off. Repeated rows are judged one by one; an
empty table gives no rows; a very long text is measured whole, in memory in proportion to its length.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

ALPHA = 0.05
DELTA = 0.05
GOOD_WEIGHT = 20.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: name: (steps of the histogram, width of a step, does a high value count against a text)
RULES = {
    "symbol_ratio": (100, 0.01, True),
    "upper_ratio": (50, 0.02, True),
    "dup_line_ratio": (50, 0.02, True),
    "repeat_ratio": (50, 0.02, True),
    "long_words": (80, 0.25, True),
    "short_words": (80, 0.25, False),
}
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def measure(text: bytes) -> tuple[int, ...]:
    """The COUNTS of one text, in order."""
    words = text.split()
    solid = text.translate(None, b" \t\n\r\x0b\x0c")
    points = len(solid.decode("utf-8", "replace"))
    seen: set[bytes] = set()
    lines = dup_lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        times = Counter(grams)
        end = 0  # words before this one are already judged
        for i, gram in enumerate(grams):
            if times[gram] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (len(words), points, len(solid) - len(solid.translate(None, b"#*$%&|<>")), dup_lines, repeated, lines, len(solid) - len(solid.translate(None, UPPER)))


def with_counts(df: DataFrame) -> DataFrame:
    """df, which has a text column, with the COUNTS in its place (and in that of columns of their names)."""
    keep = shared.others(df, "text", *COUNTS)
    df = df.select(*[F.col(f"`{c}`") for c in keep], "text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text"] + [f"{c} long" for c in COUNTS])

    def run(batches):
        for batch in shared.parts(batches):
            rows = [measure(t) for t in shared.texts_of(batch.column("text"))]
            counts = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64()) for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([*shared.columns_of(batch, keep), *counts], names=[*keep, *COUNTS])

    return df.mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratios() -> dict:
    of = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    mean = of("word_chars", "n_words")
    return {
        "symbol_ratio": of("n_symbols", "word_chars"),
        "upper_ratio": of("n_upper", "word_chars"),
        "dup_line_ratio": of("n_dup_lines", "n_lines"),
        "repeat_ratio": of("n_repeat_words", "n_words"),
        "long_words": mean,
        "short_words": mean,
    }


def steps() -> dict:
    """Per rule, the step of its histogram that a text falls into."""
    return {k: F.least(F.lit(RULES[k][0] - 1), F.floor(v / F.lit(RULES[k][1]))).cast("int") for k, v in ratios().items()}


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= x), as the incomplete beta function I(1 - p; n - x, x + 1) by its continued fraction: no list of terms."""
    if x >= n:
        return 1.0
    a, b, z = n - x, x + 1, 1 - p
    if z > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 1.0 - beta_share(b, a, p)
    return beta_share(a, b, z)


def beta_share(a: int, b: int, z: float) -> float:
    tiny = 1e-300
    d = 1.0 / (1.0 - (a + b) * z / (a + 1) or tiny)
    c, out, m = 1.0, d, 0
    while m < 100_000:
        m += 1
        change = 1.0
        for term in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / (1.0 + term * d or tiny), 1.0 + term / c or tiny
            change = d * c
            out *= change
        if abs(change - 1.0) < 1e-15:
            break
    return min(1.0, max(0.0, math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z)) * out / a))


def certified(good: list[int], bad: list[int], alpha: float, delta: float, weight: float = GOOD_WEIGHT) -> int | None:
    """good, bad: labelled documents per step, the step that is turned away first leading. How many leading steps to turn away, or None."""
    n, m = sum(good), sum(bad)
    best, choice, x, y = 0.0, None, 0, 0
    for k in range(len(good)):
        x, y = x + good[k], y + bad[k]
        if not n or binomial_cdf(x, n, alpha) > delta:
            break
        gain = y / max(1, m) - weight * x / n
        if gain > best:
            best, choice = gain, k + 1
    return choice


def fit(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: stratum and, per rule, the step from which a text is turned away (null: the rule is off)."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    held = counted.where(~base_failed()).join(one, "doc_id").select("stratum", "good", *[s.alias(k) for k, s in steps().items()])
    long = held.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("step")) for k in RULES])).alias("x"))
    histogram = shared.cut(long.groupBy("stratum", "x.rule", "x.step", "good").count())
    tests = max(1, histogram.select("stratum").distinct().count()) * len(RULES)

    def cutoffs(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": rows["stratum"].iloc[0]}
        for rule, (n, _, high) in RULES.items():
            own = rows[rows["rule"] == rule]
            table = [[0] * n, [0] * n]
            for step, good, count in zip(own["step"], own["good"], own["count"], strict=True):
                table[min(1, int(good))][step if not high else n - 1 - step] += int(count)
            k = certified(table[1], table[0], alpha / len(RULES), delta / tests)
            out[rule] = None if k is None else (n - k if high else k - 1)
        return pd.DataFrame([out]).astype({r: "Int32" for r in RULES})

    return histogram.groupBy("stratum").applyInPandas(cutoffs, "stratum string, " + ", ".join(f"{r} int" for r in RULES))


def judge(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """counted with base_failed, rejected_by (rules that turn the text away) and kept."""
    cutoffs = shared.cut(cutoffs)
    if cutoffs.count() <= 10_000:
        cutoffs = F.broadcast(cutoffs)
    joined = counted.alias("c").join(cutoffs.alias("t"), F.col("c.stratum").eqNullSafe(F.col("t.stratum")), "left")
    hits = [F.when(s >= F.col(f"t.{k}") if RULES[k][2] else s <= F.col(f"t.{k}"), F.lit(k)) for k, s in steps().items()]
    judged = joined.select("c.*", base_failed().alias("base_failed"), F.array_compact(F.array(*hits)).alias("rejected_by"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def evaluate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, stratum, the COUNTS and the verdict of every row of docs."""
    counted = shared.stored(with_counts(docs.select("doc_id", F.col("lang").alias("stratum"), "text")))
    return judge(counted, fit(counted, labels))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with the columns that they had."""
    numbers = shared.stored(with_counts(docs.select("doc_id", F.col("lang").alias("stratum"), "text")))  # so that no text is shuffled
    cutoffs = fit(numbers, read(spark, sf_dir, "labels"))
    counted = with_counts(docs.select(F.struct("*").alias("_row"), F.col("lang").alias("stratum"), "text"))
    return judge(counted, cutoffs).where("kept").select("_row.*")


@query("op10_quality")
def op10_quality(spark, sf_dir):
    judged = evaluate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", F.array_join("rejected_by", ",").alias("rejected_by"))
