"""Descriptive statistics, correlation, bootstraps, threshold selection and embedding similarity."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmura.functions import vectors as V
from murmura.operators import detector, stats, vectors
from murmura.plans import read
from murmura.plans.ratings import resampled_sql
from murmura.registry import query


@query("describe_lengths", "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS low, max(n_chars) AS high, " + ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS p{round(100 * q)}" for q in stats.QUANTILES) + " FROM documents GROUP BY lang")
def describe_lengths(spark, sf_dir):
    table = stats.described(read(spark, sf_dir, "documents").select("lang", "n_chars"), ["lang"], "n_chars")
    return table.select("lang", "n", "low", "high", *[F.round(c, 6).alias(c) for c in table.columns if c not in ("lang", "n", "low", "high")])


LABELLED = "SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"


def labelled(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")


@query("group_stats_low_n", f"WITH d AS ({LABELLED}), l AS (SELECT source, doc_id AS key, quality AS num, 1 AS den FROM d WHERE quality IS NOT NULL), " + resampled_sql("l", "source") + """
SELECT source, count(quality) AS n, count(*) FILTER (quality IS NULL) AS n_missing, round(avg(quality), 9) AS mean, CASE WHEN count(quality) >= 2 THEN round(any_value(ci_low), 6) END AS ci_low,
  CASE WHEN count(quality) >= 2 THEN round(any_value(ci_high), 6) END AS ci_high, count(quality) < 10 AS low_n FROM d LEFT JOIN ci USING (source) GROUP BY source""")
def group_stats_low_n(spark, sf_dir):
    own = stats.grouped(labelled(spark, sf_dir), "source", "quality", "doc_id")
    return own.withColumns({"mean": F.round("mean", 9), "ci_low": F.round("ci_low", 6), "ci_high": F.round("ci_high", 6)})


@query("macro_micro", "SELECT round(sum(s)::DOUBLE / sum(n), 9) AS micro, round(avg(s::DOUBLE / n), 9) AS macro FROM (SELECT source, sum(quality) AS s, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def macro_micro(spark, sf_dir):
    by = labelled(spark, sf_dir).where("quality IS NOT NULL").groupBy("source").agg(F.sum("quality").alias("s"), F.count("*").alias("n"))
    return by.agg(F.round(F.try_divide(F.sum("s").cast("double"), F.sum("n")), 9).alias("micro"), F.round(F.avg(F.try_divide(F.col("s").cast("double"), F.col("n"))), 9).alias("macro"))


@query("spearman", """WITH r AS (
  SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2::DOUBLE AS a,
    rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2::DOUBLE AS b FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) END AS rho FROM r WHERE lang IS NOT NULL GROUP BY lang""")
def spearman(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return stats.spearman(joined, ["lang"], "n_chars", "quality").withColumn("rho", F.round("rho", 6))


@query("bootstrap_cluster_ci", """WITH c AS (SELECT source AS c, sum(n_chars) AS num, count(*) AS den FROM documents GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY c NULLS LAST) - 1 AS i, count(*) OVER () AS k FROM c),
picked AS (SELECT rep, ('0x' || substr(md5('0|' || rep || '|' || i), 1, 8))::BIGINT % k AS i FROM numbered, (SELECT unnest(range(500)) AS rep)),
ratios AS (SELECT rep, sum(num)::DOUBLE / sum(den) AS r FROM picked JOIN numbered USING (i) GROUP BY rep)
SELECT round(quantile_cont(r, 0.025), 6) AS ci_low, round(quantile_cont(r, 0.975), 6) AS ci_high, count(r) AS reps FROM ratios""")
def bootstrap_cluster_ci(spark, sf_dir):
    clusters = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("c")).agg(F.sum("n_chars").alias("num"), F.count("*").alias("den"))
    return stats.bootstrap(clusters, 500, 0).select(F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "reps")


def rounded(one):
    return one.select("n", F.round("value", 9).alias("value"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "reps")


@query("bootstrap_iid_ci", "WITH x AS (SELECT 0 AS g, doc_id AS key, quality AS num, 1 AS den FROM labels), " + resampled_sql("x", "g", 3, 200) + " SELECT (SELECT count(*) FROM x) AS n, (SELECT round(avg(num), 9) FROM x) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, reps FROM ci")
def bootstrap_iid_ci(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("num"), F.lit(1).alias("den"))
    return rounded(stats.resampled(rows, [], 200, 3))


@query("bootstrap_ratio_ci", "WITH x AS (SELECT 0 AS g, doc_id AS key, toxic AS num, quality AS den FROM labels), " + resampled_sql("x", "g", 4, 200) + " SELECT (SELECT count(*) FROM x) AS n, (SELECT round(sum(num)::DOUBLE / sum(den), 9) FROM x) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, reps FROM ci")
def bootstrap_ratio_ci(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").alias("num"), F.col("quality").alias("den"))
    return rounded(stats.resampled(rows, [], 200, 4))


@query("f1_threshold", """WITH s AS (SELECT (n_chars % 101) / 100::DOUBLE AS p, quality AS y FROM documents JOIN labels USING (doc_id)),
g AS (SELECT p, sum(y) AS y, count(*) AS n FROM s GROUP BY p),
t AS (SELECT p, sum(y) OVER w AS tp, sum(n) OVER w AS fired, sum(y) OVER () AS pos FROM g WINDOW w AS (ORDER BY p DESC))
SELECT arg_max(p, 2::DOUBLE * tp / (fired + pos) + p / 1000000) AS threshold, round(max(2::DOUBLE * tp / (fired + pos)), 9) AS f1 FROM t""")
def f1_threshold(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 101 / 100).alias("p")).join(read(spark, sf_dir, "labels"), "doc_id")
    by = joined.groupBy("p").agg(F.sum("quality").alias("y"), F.count("*").alias("n"))  # at most a row per score step
    falling = Window.orderBy(F.desc("p"))
    run = by.select("p", F.sum("y").over(falling).alias("tp"), F.sum("n").over(falling).alias("fired"), F.sum("y").over(Window.partitionBy()).alias("pos"))
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("fired") + F.col("pos"))
    return run.agg(F.max_by("p", f1 + F.col("p") / 1000000).alias("threshold"), F.round(F.max(f1), 9).alias("f1"))


@query("group_folds", """WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source NULLS LAST) AS i FROM documents GROUP BY source),
dealt AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS source, 0::BIGINT AS n, 0::BIGINT AS fold
  UNION ALL SELECT g.i, list_transform(loads, lambda x, k: x + CASE WHEN k = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END), g.source, g.n, list_position(loads, list_min(loads)) - 1 FROM dealt JOIN g ON g.i = dealt.i + 1)
SELECT source, n, fold::INT AS fold FROM dealt WHERE i > 0""")
def group_folds(spark, sf_dir):
    """Sources dealt to five folds of like size."""
    return detector.group_folds(read(spark, sf_dir, "documents").select("source"), "source", 5)


UNIT = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
flat AS (SELECT label, i, avg(u[i]) AS m FROM (SELECT label, u, unnest(range(1, len(u) + 1)) AS i FROM u WHERE vec_id % 2 = 1) GROUP BY ALL),
centroid AS (SELECT label, list(m ORDER BY i) AS c FROM flat GROUP BY label)"""


def units(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", V.unit(F.col("embedding")).alias("u")).where("u IS NOT NULL")


@query("speaker_centroid_cosine", f"WITH {UNIT} SELECT label, count(*) AS n, round(avg(list_sum(list_transform(list_zip(u, c), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(c, lambda z: z * z)))), 6) AS cosine FROM u JOIN centroid USING (label) WHERE vec_id % 2 = 0 GROUP BY label")
def speaker_centroid_cosine(spark, sf_dir):
    """Odd vectors are a speaker's references, even ones are generated; the centroid is the mean of the unit references."""
    own = units(spark, sf_dir)
    centre = vectors.centroids(own.where("vec_id % 2 = 1"), "label")
    joined = own.where("vec_id % 2 = 0").join(centre, "label")
    return joined.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(V.dot(F.col("u"), F.col("centroid"))), 6).alias("cosine"))


#: References of a sample: its speaker's first ones, in order; a clip lasts 2 + vec_id % 9 seconds.
FIRST = """, numbered AS (SELECT label, vec_id, u, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM u WHERE vec_id % 2 = 1), refs AS (SELECT * FROM numbered WHERE k <= 5),
each_pair AS (SELECT s.vec_id AS sample_id, s.u AS own, r.u AS ref, r.vec_id AS clip FROM u s JOIN refs r USING (label) WHERE s.vec_id % 2 = 0)"""


def with_references(spark, sf_dir):
    own = units(spark, sf_dir)
    order = Window.partitionBy("label").orderBy("vec_id")
    few = own.where("vec_id % 2 = 1").select("label", "vec_id", F.row_number().over(order).alias("k")).where("k <= 5").groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("refs"))
    samples = own.where("vec_id % 2 = 0").join(few, "label").select(F.col("vec_id").alias("sample_id"), "u", "refs")
    return samples, own.select(F.col("vec_id").alias("clip"), "u", (2.0 + F.col("vec_id") % 9).alias("seconds"))


@query("mean_cosine", f"WITH {UNIT}{FIRST} SELECT sample_id, round(avg(list_sum(list_transform(list_zip(own, ref), lambda z: z[1] * z[2]))), 6) AS cosine, count(*) AS n_ref_clips, sum(2.0::DOUBLE + clip % 9) AS ref_seconds FROM each_pair GROUP BY sample_id")
def mean_cosine(spark, sf_dir):
    return vectors.similarity(*with_references(spark, sf_dir), "mean_cosine").select("sample_id", F.round("cosine", 6).alias("cosine"), "n_ref_clips", "ref_seconds")


@query("sample_centroid_cosine", f"""WITH {UNIT}{FIRST}, means AS (SELECT sample_id, i, avg(ref[i]) AS m, any_value(own[i]) AS o FROM (SELECT *, unnest(range(1, len(ref) + 1)) AS i FROM each_pair) GROUP BY ALL)
SELECT sample_id, round(sum(m * o) / sqrt(sum(m * m)), 6) AS cosine FROM means GROUP BY sample_id""")
def sample_centroid_cosine(spark, sf_dir):
    return vectors.similarity(*with_references(spark, sf_dir), "centroid").select("sample_id", F.round("cosine", 6).alias("cosine"))
