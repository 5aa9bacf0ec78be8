"""Text normalisation, quality flags, tags and word error rates."""

from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.operators import align
from murmura.functions.arrays import once
from murmura.operators import events as E
from murmura.operators import stats
from murmura.plans import fixtures as X
from murmura.plans import read, spread
from murmura.plans.ratings import resampled_sql
from murmura.registry import query


def rated(spark, sf_dir):
    """Recognitions stand beside their texts here, so nothing is shuffled before the aggregates."""
    return align.rated_pairs(X.heard(spark, sf_dir))


@query("wer_errors_by_speaker", f"""WITH {X.RATED} SELECT speaker, count(*) AS n, count(error) AS failed, sum(ref_words)::BIGINT AS ref_words, sum(hyp_words)::BIGINT AS hyp_words,
  sum(errors)::BIGINT AS errors, sum(errors)::DOUBLE / nullif(sum(ref_words), 0) AS wer FROM rated GROUP BY speaker""")
def wer_errors_by_speaker(spark, sf_dir):
    return rated(spark, sf_dir).groupBy("speaker").agg(
        F.count("*").alias("n"), F.count("error").alias("failed"), *[F.sum(c).alias(c) for c in ("ref_words", "hyp_words", "errors")],
        align.corpus_rate(F.col("errors"), F.col("ref_words")).alias("wer"),
    )


@query("wer_corpus_mean_macro", f"""WITH RECURSIVE {X.PATHS}, by_speaker AS (
  SELECT speaker, sum(errors) AS e, sum(ref_words) AS r, sum(errors::DOUBLE / nullif(ref_words, 0)) AS s, count(errors::DOUBLE / nullif(ref_words, 0)) AS n, count(*) AS every, count(error) AS failed, count(*) FILTER (digits) AS digits FROM rated GROUP BY speaker)
SELECT sum(e)::DOUBLE / sum(r) AS corpus, round(sum(s) / sum(n), 9) AS mean, round(avg(e::DOUBLE / nullif(r, 0)), 9) AS macro, (SELECT sum(sub)::BIGINT FROM sdi) AS sub, (SELECT sum(del)::BIGINT FROM sdi) AS del,
  (SELECT sum(ins)::BIGINT FROM sdi) AS ins, sum(every)::BIGINT AS n_samples, sum(failed)::BIGINT AS n_failed, sum(digits)::BIGINT AS n_hyp_with_digits FROM by_speaker""")
def wer_corpus_mean_macro(spark, sf_dir):
    one = align.summarised(rated(spark, sf_dir))
    return one.withColumns({c: F.round(c, 9) for c in ("mean", "macro")})


@query("wer_worst_samples", f"WITH {X.RATED} SELECT sample_id, sum(errors)::DOUBLE / sum(ref_words) AS wer FROM rated GROUP BY sample_id HAVING sum(ref_words) > 0 ORDER BY wer DESC, sample_id LIMIT 10")
def wer_worst_samples(spark, sf_dir):
    by = rated(spark, sf_dir).groupBy("sample_id").agg(align.corpus_rate(F.col("errors"), F.col("ref_words")).alias("wer"))
    return by.where("wer IS NOT NULL").orderBy(F.desc("wer"), "sample_id").limit(10)


@query("wer_sdi", f"WITH RECURSIVE {X.PATHS} SELECT speaker, sum(sub)::BIGINT AS sub, sum(del)::BIGINT AS del, sum(ins)::BIGINT AS ins FROM sdi GROUP BY speaker")
def wer_sdi(spark, sf_dir):
    return rated(spark, sf_dir).where("error IS NULL").groupBy("speaker").agg(*[F.sum(k).alias(k) for k in ("sub", "del", "ins")])


@query("wer_whole_texts")
def wer_whole_texts(spark, sf_dir):
    """Errors of whole texts, each aligned as one, in memory that grows with its length. Its tables are too large for SQL; tests hold it against the full table."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    words = docs.select("doc_id", F.col("source").alias("speaker"), once(T.words(F.coalesce("text", F.lit(""))), "raw"))
    own = words.select("speaker", F.array_join("raw", " ").alias("text"), F.array_join(X.slips(F.col("doc_id"), F.lit(0), F.col("raw")), " ").alias("heard"), F.lit(None).cast("string").alias("error"))
    return align.rated_pairs(own).groupBy("speaker").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("ref_words", "hyp_words", "sub", "del", "ins")])


@query("wer_intervals", f"WITH {X.RATED}, x AS (SELECT 0 AS g, {{'a': sample_id, 'b': k}} AS key, errors AS num, ref_words AS den, speaker FROM rated WHERE error IS NULL), y AS (SELECT g, speaker AS key, sum(num) AS num, sum(den) AS den FROM x GROUP BY ALL), {resampled_sql('x', 'g', 7, 20)}, {resampled_sql('y', 'g', 7, 20, 'cl')} SELECT count(*) AS n, round(sum(num)::DOUBLE / sum(den), 9) AS value, round((SELECT ci_low FROM ci), 6) AS ci_low, round((SELECT ci_high FROM ci), 6) AS ci_high, (SELECT count(*) FROM y) AS clusters, round((SELECT ci_low FROM cl), 6) AS cluster_low, round((SELECT ci_high FROM cl), 6) AS cluster_high FROM x")
def wer_intervals(spark, sf_dir):
    """The corpus error rate with intervals over utterances and over speakers."""
    return stats.rounded(align.intervals(rated(spark, sf_dir).withColumn("key", F.struct(F.col("sample_id").alias("a"), F.col("k").alias("b"))), reps=20, seed=7))


@query("wer_failures", f"WITH {X.RATED} SELECT coalesce(error, 'none') AS error, count(*) AS n FROM rated GROUP BY ALL")
def wer_failures(spark, sf_dir):
    """Recognitions as a table of their own, joined to the texts."""
    return align.rated(*X.spoken(spark, sf_dir), ["sample_id", "k"]).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


@query("normalize_text", r"SELECT doc_id, md5(n) AS digest, len(n) AS size FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[\p{P}\p{S}]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS n FROM documents)")
def normalize_text(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select("doc_id", T.normalized(T.nfc(F.col("text"))).alias("n"))
    return own.select("doc_id", F.md5(F.col("n").cast("binary")).alias("digest"), F.length("n").cast("long").alias("size"))


@query("quality_flags", f"SELECT speaker, count(*) AS n, " + ", ".join(f"count(*) FILTER (regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')) AS {k}" for k, p in T.FLAGS.items())
  + f", count(*) FILTER (t <> nfc_normalize(t)) AS decomposed FROM (SELECT source AS speaker, {X.TAGGED} AS t FROM documents) GROUP BY speaker")
def quality_flags(spark, sf_dir):
    """Nine flags of the tagged transcripts, by speaker."""
    own = X.texts(spark, sf_dir).withColumn("nfc", T.nfc(F.col("tagged")))
    flags = [F.count_if(F.col("tagged").rlike(p)).alias(k) for k, p in T.FLAGS.items()]
    return own.groupBy("speaker").agg(F.count("*").alias("n"), *flags, F.count_if(F.col("tagged") != F.col("nfc")).alias("decomposed"))


MALFORMED = f"torn AS (SELECT doc_id, source, {X.TAGGED} || CASE doc_id % 4 WHEN 0 THEN ' [laughter' WHEN 1 THEN ' [Cough]' WHEN 2 THEN ' [[x]]' ELSE '[]' END AS t FROM documents)"


def torn(spark, sf_dir):
    more = F.when(F.col("sample_id") % 4 == 0, " [laughter").when(F.col("sample_id") % 4 == 1, " [Cough]").when(F.col("sample_id") % 4 == 2, " [[x]]").otherwise("[]")
    return X.texts(spark, sf_dir).withColumn("tagged", F.concat("tagged", more))


@query("malformed_policy", "WITH " + MALFORMED + r""", judged AS (SELECT source AS speaker, regexp_matches(regexp_replace(t, '\[[^\[\]]*\]', ' ', 'g'), '[\[\]]') AS bad,
  len(list_filter(regexp_extract_all(t, '\[[^\[\]]*\]'), lambda x: NOT list_contains(['breathing', 'laughter', 'throatclearing'], trim(lower(x[2:-2]))))) AS strange, len(regexp_extract_all(t, '\[[^\[\]]*\]')) AS tags FROM torn)
SELECT speaker, count(*) AS n, count(*) FILTER (bad) AS unbalanced, count(*) FILTER (NOT bad AND strange > 0) AS unknown, (sum(tags) FILTER (NOT bad))::BIGINT AS kept, (sum(tags - strange) FILTER (NOT bad))::BIGINT AS dropped FROM judged GROUP BY speaker""")
def malformed_policy(spark, sf_dir):
    """Texts with torn or unknown tags under each policy: errors as rows, events kept, and events left once unknown tags are dropped."""
    known = [t for _, t in X.TAGS]
    rows = torn(spark, sf_dir)
    ways = [T.parsed(F.col("tagged"), known, p).alias(p) for p in ("error", "keep", "drop")]
    return rows.select("speaker", *ways).groupBy("speaker").agg(
        F.count("*").alias("n"), F.count_if(F.col("keep.error").isNotNull()).alias("unbalanced"), F.count_if(F.col("error.error").startswith("unknown")).alias("unknown"),
        F.sum(F.size("keep.events")).alias("kept"), F.sum(F.size("drop.events")).alias("dropped"),
    )


@query("tag_roundtrip", f"WITH {X.TOKENS} SELECT sample_id, md5(array_to_string(a, ' ')) AS digest, true AS same FROM tok WHERE a IS NOT NULL")
def tag_roundtrip(spark, sf_dir):
    """Texts rendered from their words and events, and whether they parse to the same again."""
    once = X.parsed(spark, sf_dir).where("error IS NULL").withColumn("text", T.rendered(F.col("words"), F.col("events")))
    again = once.withColumn("p", T.parsed(F.col("text")))
    same = (F.col("p.words") == F.col("words")) & (F.col("p.events") == F.col("events"))
    return again.select("sample_id", F.md5(F.col("text").cast("binary")).alias("digest"), same.alias("same"))
