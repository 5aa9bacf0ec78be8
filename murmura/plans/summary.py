"""The whole evaluation as one row, and fields described."""

from pyspark.sql import functions as F

from murmura.functions import scoring
from murmura.operators import report, stats
from murmura.plans import fixtures as X
from murmura.plans import placement, read, transcripts
from murmura.plans.ratings import resampled_sql
from murmura.registry import query


def parts(spark, sf_dir):
    """Results by document: placement of its events, errors of its utterances, and values of two metrics that lack some."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("speaker"), "n_chars")
    hits = placement.hit_counts(spark, sf_dir)
    errors = transcripts.rated(spark, sf_dir).groupBy("sample_id").agg(F.sum("errors").alias("errors"), F.sum("ref_words").alias("ref_words"))
    own = docs.select("sample_id", "speaker", F.when(F.col("sample_id") % 7 != 0, 1 + 4 * (F.col("n_chars") % 401 / 400)).alias("pmos"), F.when(F.col("sample_id") % 5 != 0, F.col("n_chars") % 31 / 15 - 1).alias("cosine"))
    return own.join(hits, "sample_id", "left").join(errors, "sample_id", "left")


def human(spark, sf_dir):
    """Ratings of every eighth document."""
    n = F.col("n_chars")
    docs = read(spark, sf_dir, "documents").where("doc_id % 8 = 0")
    return docs.select(F.col("doc_id").alias("sample_id"), (1 + n % 9 / 2).alias("sn"), (1 + n % 7 / 2).alias("q"), F.when(n % 3 != 0, 1 + n % 5).alias("placement"))


W = scoring.WEIGHTS["A"]
PARTS = "RECURSIVE " + X.RATED + "," + placement.OUTCOMES.strip() + """,
parts AS (SELECT doc_id AS sample_id, source AS speaker, CASE WHEN doc_id % 7 <> 0 THEN 1 + 4 * (n_chars % 401 / 400::DOUBLE) END AS pmos, CASE WHEN doc_id % 5 <> 0 THEN n_chars % 31 / 15::DOUBLE - 1 END AS cosine, hits, events, errors, ref_words FROM documents
  LEFT JOIN (SELECT sample_id AS doc_id, count(*) FILTER (hit) AS hits, count(*) AS events FROM judged GROUP BY ALL) USING (doc_id)
  LEFT JOIN (SELECT sample_id AS doc_id, sum(errors) AS errors, sum(ref_words) AS ref_words FROM rated GROUP BY ALL) USING (doc_id)),
human AS (SELECT doc_id AS sample_id, 1 + n_chars % 9 / 2::DOUBLE AS sn, 1 + n_chars % 7 / 2::DOUBLE AS q, CASE WHEN n_chars % 3 <> 0 THEN 1 + n_chars % 5 END AS placement FROM documents WHERE doc_id % 8 = 0),
own AS (SELECT sum(hits)::DOUBLE / sum(events) AS nvpa, sum(errors)::DOUBLE / sum(ref_words) AS wer, avg(pmos) AS pmos, avg(cosine) AS ss FROM parts),
sub AS (SELECT sum(hits)::DOUBLE / sum(events) AS nvpa, sum(errors)::DOUBLE / sum(ref_words) AS wer, avg(pmos) AS pmos, avg(cosine) AS ss FROM parts WHERE sample_id % 8 = 0),
ranked AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2::DOUBLE AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2::DOUBLE AS p FROM (SELECT hits::DOUBLE / events AS a, placement AS p FROM parts JOIN human USING (sample_id) WHERE events > 0 AND placement IS NOT NULL))
"""  # fmt: skip
SCORE = f"{W['nvpa']}::DOUBLE * nvpa + {W['wer']}::DOUBLE * (1 - least(wer, 1)) + {W['pmos']}::DOUBLE * (pmos - 1) / 4 + {W['ss']}::DOUBLE * greatest(ss, 0)"


@query("score_summary", f"""WITH {PARTS} SELECT round(nvpa, 9) AS nvpa, round(wer, 9) AS wer, round(pmos, 9) AS pmos, round(ss, 9) AS ss, round({SCORE}, 9) AS auto,
  round((SELECT {SCORE} FROM sub) + {W['sn']}::DOUBLE * ((SELECT avg(sn) FROM human) - 1) / 4 + {W['q']}::DOUBLE * ((SELECT avg(q) FROM human) - 1) / 4, 9) AS final,
  (SELECT count(*) FROM human) AS n_rated, (SELECT count(*) FROM human) AS n_subset, (SELECT count(*) FROM ranked) AS n_common, (SELECT round(covar_pop(a, p) / (stddev_pop(a) * stddev_pop(p)), 6) FROM ranked) AS rho, '' AS missing_auto, '' AS missing_final FROM own""")
def score_summary(spark, sf_dir):
    """Components, the automatic and the final score, and the agreement of placement with listeners."""
    one = report.summary(parts(spark, sf_dir), human(spark, sf_dir))
    return one.select(*[F.round(c, 9).alias(c) for c in (*scoring.AUTOMATIC, "auto", "final")], "n_rated", "n_subset", "n_common", F.round("rho", 6).alias("rho"), "missing_auto", "missing_final")


LONG = "x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, sample_id AS key, ({a})::DOUBLE AS num, ({b})::DOUBLE AS den, speaker FROM parts WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for k, a, b in (("nvpa", "hits", "events"), ("wer", "errors", "ref_words"), ("pmos", "pmos", "1"), ("ss", "cosine", "1"))) + "), y AS (SELECT metric, speaker AS key, sum(num) AS num, sum(den) AS den FROM x GROUP BY ALL)"


@query("score_intervals", f"WITH {PARTS}, {LONG}, {resampled_sql('x', 'metric', 8, 40)}, {resampled_sql('y', 'metric', 8, 40, 'cl')} SELECT x.metric, count(*) AS n, round(sum(num) / sum(den), 9) AS value, round(any_value(ci.ci_low), 6) AS ci_low, round(any_value(ci.ci_high), 6) AS ci_high, any_value(k.clusters) AS clusters, round(any_value(cl.ci_low), 6) AS cluster_low, round(any_value(cl.ci_high), 6) AS cluster_high FROM x JOIN ci USING (metric) JOIN cl USING (metric) JOIN (SELECT metric, count(*) AS clusters FROM y GROUP BY metric) k USING (metric) GROUP BY x.metric")
def score_intervals(spark, sf_dir):
    """The summary's components with intervals over samples and over speakers."""
    return stats.rounded(report.intervals(parts(spark, sf_dir), 40, 8))


FIELD = """f AS (SELECT doc_id, source, CASE WHEN doc_id % 7 <> 0 THEN 1 + 4 * (n_chars % 401 / 400::DOUBLE) END AS pmos FROM documents), x AS (SELECT 0 AS g, doc_id AS key, pmos AS num, 1 AS den FROM f WHERE pmos IS NOT NULL),
"""


@query("field_summary", f"WITH {FIELD}{resampled_sql('x', 'g')} SELECT 'pmos' AS field, count(*) FILTER (pmos IS NULL) AS n_missing, count(pmos) AS n, round(avg(pmos), 9) AS mean, round(stddev_pop(pmos), 9) AS std, " + ", ".join(f"round(quantile_cont(pmos, {q}), 6) AS p{round(100 * q)}" for q in stats.QUANTILES) + ", round((SELECT ci_low FROM ci), 6) AS ci_low, round((SELECT ci_high FROM ci), 6) AS ci_high, round((SELECT avg(m) FROM (SELECT avg(pmos) AS m FROM f GROUP BY source)), 9) AS macro_speaker FROM f")
def field_summary(spark, sf_dir):
    """One metric's field described, with its interval and the mean of speakers' means."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("speaker"), F.when(F.col("doc_id") % 7 != 0, 1 + 4 * (F.col("n_chars") % 401 / 400)).alias("pmos"))
    one = report.field(docs, "pmos")
    return one.select("field", "n_missing", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std", "macro_speaker")], *[F.round(c, 6).alias(c) for c in ("p5", "p25", "p50", "p75", "p95", "ci_low", "ci_high")])
