"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings. DataFrame functions only.

Base spans come from three patterns. The method adds spans of kind entropy: candidates are runs of the characters
that keys are made of; each candidate has a character class, which sets how much entropy a window must have. A fold goes
over the candidate's characters and keeps the counts of the window and the sum of c * log2(c); one character enters
and one leaves, so each step changes two counts and four terms. The span goes from the first window that reaches the
class's threshold to the last. The allow list suppresses candidates that are words or paths as a whole, and inside others it
blanks UUIDs, placeholders and ladders of digits or letters, so that a key beside them is still found; base spans are never
suppressed.

Everything happens where a text is read: no shuffle, no broadcast, no Python. A text costs one pass per pattern, and one
step per character of its candidates. Results of folds are copied at every step, so hits are placed in groups of about the
square root of their number; no pattern repeats a group, which the JVM's matcher would do by recursion.

Defined results: a null text counts as empty and has no spans; overlapping spans of several kinds are all listed; rows are
independent, so repeated rows give equal results; extra columns are left alone, but for one named _spans, which is replaced.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.llm.registry import query, read

#: Kinds in order: pattern, group that is measured, its least length. Shorter hex and access runs can never hold a longer
#: one, so their least lengths are in the pattern; a short assignment does consume text, so its length is tested afterwards.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
KINDS = (*BASE, "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes: pattern of the whole candidate and bits that a window must have; the first that fits counts.
CLASSES = {"digits": (r"^[0-9+/_=-]+$", math.inf), "hex": (r"^[0-9A-Fa-f]+$", 3.2), "alnum": (r"^[A-Za-z0-9]+$", 3.8), "base64": (r"", 3.9)}
#: A candidate with none of these is made of words, each of small letters with a capital at most at its head, and separators.
NO_WORDS = r"[0-9]|[A-Z](?![a-z])|[a-z][A-Z]|^[/_=+-]"
#: What is blanked inside a candidate, and its length.
ALLOW = {
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}": 36,
    **{rf"(?i){w}": len(w) for w in ("example", "sample", "dummy", "placeholder", "changeme", "redacted", "0123456789", "abcdefghij", "qwertyuiop")},
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MARK = "[SECRET]"


SPANS = "array<struct<start:int,kind:int,end:int>>"


def bound(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


def walked(items: Column, carry: Column, kind: str, step) -> Column:
    """struct<carry, out>: step(carry, x) gives the next carry and an array of type kind; out has all arrays' elements.

    Folds copy their state at each step, so items are taken in groups of about the square root of their number.
    """

    def inside(state, x):
        after, more = step(state["carry"], x)
        return F.struct(after.alias("carry"), F.concat(state["out"], more).alias("out"))

    def outside(items, width):
        def group(state, k):
            part = F.aggregate(F.slice(items, k + 1, width), F.struct(state["carry"].alias("carry"), none_of(kind).alias("out")), inside)
            return bound(part, lambda p: F.struct(p["carry"].alias("carry"), F.concat(state["out"], F.array(p["out"])).alias("out")))

        places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, width)).otherwise(none_of("array<int>"))
        start = F.struct(carry.alias("carry"), none_of(f"array<{kind}>").alias("out"))
        return F.aggregate(places, start, group, lambda s: F.struct(s["carry"].alias("carry"), F.flatten(s["out"]).alias("out")))

    return bound(items, lambda x: outside(x, F.ceil(F.sqrt(F.size(x) + 1)).cast("int")))


def located(pieces: Column, hits: Column, span) -> Column:
    """The spans of an array of hits, given the texts between them; span(start of the hit, hit) gives one or null."""

    def step(at, x):
        start = at + x["skip"]
        return start + F.length(x["hit"]["whole"]), F.array_compact(F.array(span(start, x["hit"])))

    pairs = F.zip_with(F.transform(pieces, F.length), hits, lambda n, h: F.struct(n.alias("skip"), h.alias("hit")))
    return walked(F.filter(pairs, lambda x: x["hit"].isNotNull()), F.lit(0), SPANS, step)["out"]


def windowed(candidate: Column) -> Column:
    """struct<first, last>: where the first and the last window with enough entropy begin and end; null without any."""
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES.values()):
        least = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(least)
    left = F.concat(F.lit(" " * WINDOW), candidate.substr(F.lit(1), F.length(candidate) - WINDOW))
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    moves = F.zip_with(F.split(candidate, ""), F.split(left, ""), lambda i, o: F.struct(place(i).alias("i"), place(o).alias("o")))
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), least.alias("least"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def step(s, x):
        same = x["i"] == x["o"]
        count_in = F.element_at(s["counts"], x["i"])
        count_out = F.element_at(s["counts"], F.greatest(x["o"], F.lit(1)))
        entered = F.element_at(term, count_in + 2) - F.element_at(term, count_in + 1)
        gone = F.when(x["o"] > 0, F.element_at(term, count_out) - F.element_at(term, count_out + 1)).otherwise(0.0)
        total = F.when(same, s["sum"]).otherwise(s["sum"] + entered + gone)
        counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda c, k: c + (k + 1 == x["i"]).cast("int") - (k + 1 == x["o"]).cast("int")))
        high = (s["n"] + 1 >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= s["least"])
        return F.struct(
            (s["n"] + 1).alias("n"), total.alias("sum"), counts.alias("counts"), s["least"].alias("least"),
            F.when(s["first"].isNull() & high, s["n"] + 1 - WINDOW).otherwise(s["first"]).alias("first"), F.when(high, s["n"] + 1).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(moves, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def blanked(candidate: Column) -> Column:
    """The candidate with a run of one character in place of what the allow list names."""
    out = candidate
    for pattern, size in ALLOW.items():
        out = F.regexp_replace(out, pattern, "-" * size)
    return F.when(reduce(or_, [candidate.rlike(p) for p in ALLOW]), out).otherwise(candidate)


def spans_of(text: Column) -> Column:
    """All spans of a text, in order."""

    def base(k, pattern, group, least):
        value = (lambda x: F.regexp_extract(x, pattern, group)) if group else lambda x: x
        hit = lambda x: F.struct(x.alias("whole"), F.length(value(x)).alias("size"))
        span = lambda start, h: F.when(h["size"] >= least, F.struct(start.alias("start"), F.lit(k).alias("kind"), (start + F.length(h["whole"])).alias("end")))
        return pattern, hit, span

    def hit(x):
        return F.struct(x.alias("whole"), F.when(x.rlike(NO_WORDS), bound(blanked(x), windowed)).alias("w"))

    def span(start, h):
        own = F.struct((start + h["w"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (start + h["w"]["last"]).alias("end"))
        return F.when(h["w"]["last"].isNotNull(), own)

    def found(pattern, of_hit, of_span):
        place = lambda hits: located(F.split(text, pattern, -1), F.transform(hits, of_hit), of_span)
        return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, place(hits)).otherwise(none_of(SPANS)))

    parts = [found(*base(k, *x)) for k, x in enumerate(BASE.values())] + [found(CANDIDATE, hit, span)]
    return F.array_sort(F.concat(*parts))


def scan(docs: DataFrame) -> DataFrame:
    """docs with _spans, array<struct<start, kind, end>> in order (code points, end exclusive; kind by its place in KINDS)."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "_spans"], spans_of(F.coalesce(F.col("text"), F.lit(""))).alias("_spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with MARK in place of each run of overlapping spans."""
    run = "struct<start:int,end:int>"

    def step(open_, s):
        inside = (open_["end"] > s["start"]) & (open_["start"] >= 0)
        grown = F.struct(open_["start"].alias("start"), F.greatest(open_["end"], s["end"]).alias("end"))
        return F.when(inside, grown).otherwise(F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.when(inside, none_of(f"array<{run}>")).otherwise(F.array(open_))

    def kept(text, runs):
        """The parts between the runs; each group of parts is cut out of the text at once, as a cut costs its distance."""
        width = F.ceil(F.sqrt(F.size(runs))).cast("int")

        def group(k):
            part = F.slice(runs, k + 1, width + 1)  # the next group's first run ends this one's last part
            return bound(part, lambda p: bound(p[0]["end"], lambda first: bound(text.substr(first + 1, F.element_at(p, -1)["start"] - first), lambda own: cuts(own, first, p))))

        def cuts(own, first, p):
            pairs = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.struct(a["end"].alias("a"), b["start"].alias("b")))
            return F.transform(pairs, lambda x: own.substr(x["a"] - first + 1, x["b"] - x["a"]))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs) - 2, width), group)), MARK)

    before = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("end"))
    after = F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("end")))
    merged = walked(spans, before, f"array<{run}>", step)
    return bound(text, lambda t: bound(merged, lambda m: bound(F.concat(m["out"], F.array(m["carry"]), after), lambda runs: kept(t, runs))))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced by MARK; n_chars follows the text."""
    scanned = scan(docs.select(F.struct("*").alias("_row"), "text"))
    found = F.size("_spans") > 0
    fields = []
    for c in docs.columns:
        value = F.col("_row")[c]
        if c == "text":
            value = F.when(found, redacted(F.col("text"), F.col("_spans"))).otherwise(value)
        fields.append(value.alias(c))
    out = scanned.select(*fields)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@query("op4_secrets")
def op4_secrets(spark, sf_dir):
    spans = F.col("_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_entropy"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"),
    )
