"""A corpus described: splits, speakers, tags, structure, lengths and rates, quality and file formats.

utterances: split, speaker, audio, tagged, lang, more (names of further keys, with bars between), as sources.corpus.scan gives them; infos: clip
(the same path as audio), rate, channels, bits, frames, seconds, error, as sources.audio.probed gives them. Nothing here fails on a torn text:
its brackets stay words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.functions.arrays import once
from murmura.operators import events as E
from murmura.operators import stats

MEASURES = ("words", "seconds", "words_per_second", "events_per_second")


def analysed(utterances: DataFrame, infos: DataFrame | None = None, language: str | None = None) -> DataFrame:
    """utterances with words (their number), events (e, type, gap), clean (the text without tags), flags, and seconds and error of their files."""
    parts = utterances.withColumn("tagged", F.coalesce("tagged", F.lit(""))).select("*", once(T.tolerant(F.col("tagged")), "_p"))
    own = parts.select(*utterances.columns, F.size("_p.words").alias("words"), F.col("_p.events").alias("events"), F.array_join("_p.words", " ").alias("clean"))
    flags = [F.col("tagged").rlike(p).alias(k) for k, p in T.FLAGS.items() if k != "wide"]
    strange = (T.foreign(F.col("clean"), language) if language else F.array().cast("array<string>")).alias("foreign")
    out = own.select("*", *flags, (F.col("tagged") != T.nfc(F.col("tagged"))).alias("decomposed"), strange)
    if infos is None:
        return out.withColumn("seconds", F.lit(None).cast("double"))
    heard = infos.select(F.col("clip").alias("audio"), "seconds", F.col("error").alias("file_error"), F.lit(True).alias("there"))
    return out.join(heard, "audio", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def overview(own: DataFrame) -> DataFrame:
    return own.groupBy("split").agg(
        F.count_distinct("speaker").alias("speakers"), F.count("*").alias("utterances"), F.sum("words").alias("words"), F.sum(F.size("events")).alias("events"),
        F.count_if(F.size("events") == 0).alias("without_events"), (F.sum("seconds") / 3600).alias("hours"),
    )


def speakers(own: DataFrame, splits: list[str], tags: list[str], of: str = "train") -> DataFrame:
    """A row a speaker: utterances and minutes in each split, and how often each tag occurs in one of them."""
    sums = [x for s in splits for x in (F.count_if(F.col("split") == s).alias(f"{s}_n"), F.coalesce(F.sum(F.when(F.col("split") == s, F.col("seconds"))) / 60, F.lit(0.0)).alias(f"{s}_minutes"))]
    times = lambda t: F.when(F.col("split") == of, F.size(F.filter("events", lambda e: e["type"] == t))).otherwise(0)
    return own.groupBy("speaker").agg(*sums, *[F.sum(times(t)).alias(f"{of}_{t}") for t in tags])


def tags(own: DataFrame, listed: list[str]) -> DataFrame:
    """A row a split and tag, the listed ones first: how many, in how many texts, per hundred words and minute, and where."""
    total = own.groupBy("split").agg(F.count("*").alias("_texts"), F.sum("words").alias("_words"), (F.sum("seconds") / 60).alias("_minutes"))  # a row a split
    place = E.position(F.col("gap"), F.col("words"))
    each = own.withColumn("_id", F.struct("speaker", "audio")).select("split", "_id", "words", F.inline("events"))
    by = each.groupBy("type", "split").agg(F.count("*").alias("n"), F.count_distinct("_id").alias("texts"), *[F.count_if(place == x).alias(f"at_{x}") for x in ("start", "mid", "end")])
    share = lambda a, b, times=100.0: F.try_divide(times * F.col(a), F.col(b))
    joined = by.join(F.broadcast(total), "split").withColumn("unlisted", ~F.col("type").isin(listed))
    return joined.select("type", "split", "n", "texts", share("texts", "_texts").alias("percent"), share("n", "_words").alias("per_100_words"), share("n", "_minutes", 1.0).alias("per_minute"), "at_start", "at_mid", "at_end", "unlisted").orderBy("unlisted", "type", "split")


def measures(own: DataFrame, quantiles: tuple = (0.0, *stats.QUANTILES, 1.0)) -> DataFrame:
    """A row a split and measure: words, seconds, words and events a second, described."""
    rate = lambda c: F.try_divide(c.cast("double"), F.col("seconds"))
    values = (F.col("words").cast("double"), F.col("seconds"), rate(F.col("words")), rate(F.size("events")))
    long = own.select("split", F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in zip(MEASURES, values, strict=True)])))
    return stats.described(long.where("x IS NOT NULL"), ["split", "measure"], "x", quantiles)


def quality(own: DataFrame) -> DataFrame:
    """A row a split: utterances with each flag, with letters outside the language, and without words."""
    names = [k for k in T.FLAGS if k != "wide"] + ["decomposed"]
    return own.groupBy("split").agg(F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in names], F.count_if(F.size("foreign") > 0).alias("foreign"), F.count_if(F.col("words") == 0).alias("empty"))


def counters(own: DataFrame) -> DataFrame:
    """A row a split and value of what is counted: the language, and each further key of the metadata."""
    langs = own.select("split", F.lit("language").alias("what"), F.col("lang").alias("value"))
    keys = own.select("split", F.lit("key").alias("what"), F.explode(F.filter(F.split(F.coalesce("more", F.lit("")), r"\|"), lambda x: x != "")).alias("value"))
    return langs.unionByName(keys).groupBy("split", "what", "value").agg(F.count("*").alias("n"))


def formats(infos: DataFrame) -> DataFrame:
    """A row a rate, channels, bits and error of files: how many."""
    return infos.groupBy("rate", "channels", "bits", "error").agg(F.count("*").alias("n"))


def repeated(own: DataFrame) -> DataFrame:
    """A row a split: texts that repeat one of the same split, compared by digest of the clean text."""
    by = own.groupBy("split", F.sha2(F.col("clean").cast("binary"), 256).alias("h")).agg(F.count("*").alias("c"))
    return by.groupBy("split").agg(F.sum(F.col("c") - 1).alias("repeated"))


def listed(own: DataFrame) -> DataFrame:
    """A row an utterance, as the table of utterances shows it."""
    types = F.transform("events", lambda e: e["type"])
    places = F.transform("events", lambda e: E.position_or_only(e["gap"], F.col("words")))
    return own.select("split", "speaker", "audio", "seconds", "words", F.size("events").alias("n_events"), types.alias("types"), F.transform("events", lambda e: e["gap"]).alias("gaps"), places.alias("places"), F.col("tagged").alias("text"), "clean")
