"""Human ratings, and scores made of all components."""

from pyspark.sql import functions as F

from murmura.functions import scoring
from murmura.operators import ratings as R
from murmura.operators import stats
from murmura.plans import read
from murmura.registry import query

#: Sheets made of the events table: rater, item and four ratings as typed by hand (decimal commas, blanks, slips); and the key of the items.
SHEET = """
sheet AS (
  SELECT user_id % 7 AS rater, event_id % 997 AS item,
    CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '6' ELSE replace((1 + (event_id * 7 % 9) / 2.0::DOUBLE)::VARCHAR, '.', ',') END AS sn,
    CASE WHEN event_id % 13 = 0 THEN ' ' ELSE (CASE WHEN event_id % 997 % 20 = 0 THEN 5.0::DOUBLE - (user_id % 7) / 2::DOUBLE WHEN event_id % 997 % 20 = 1 THEN 1.0::DOUBLE ELSE 1 + (event_id * 5 % 9) / 2.0::DOUBLE END)::VARCHAR END AS q,
    (1 + event_id % 5)::VARCHAR AS naturalness, CASE WHEN event_id % 3 = 0 THEN (1 + event_id * 3 % 5)::VARCHAR END AS placement FROM events),
key AS (SELECT range AS item, CASE range % 20 WHEN 0 THEN 'anchor_gt' WHEN 1 THEN 'anchor_degraded' ELSE 'model' END AS kind, 's' || range AS sample_id, range % 30 AS speaker FROM range(980)),
clean AS (SELECT rater, item, sn AS typed, """ + ", ".join(f"CASE WHEN try_cast(replace(trim({f}), ',', '.') AS DOUBLE) BETWEEN 1 AND 5 THEN try_cast(replace(trim({f}), ',', '.') AS DOUBLE) END AS {f}" for f in R.FIELDS) + """ FROM sheet)
"""  # fmt: skip
RATERS = SHEET + """,
means AS (SELECT rater, count(s) AS n_items, avg(s) FILTER (kind = 'anchor_gt') AS gt, avg(s) FILTER (kind = 'anchor_degraded') AS degraded
  FROM (SELECT rater, kind, coalesce((sn + q) / 2, sn, q) AS s FROM clean JOIN key USING (item)) GROUP BY rater),
raters AS (SELECT *, gt < 3 AS low, gt - degraded < 0.5::DOUBLE AS no_gap, NOT coalesce(gt < 3, false) AND NOT coalesce(gt - degraded < 0.5::DOUBLE, false) AS accepted FROM means),
rated AS (SELECT rater, sample_id, speaker, sn, q, naturalness, placement FROM clean JOIN key USING (item) JOIN raters USING (rater) WHERE kind = 'model' AND accepted),
samples AS (SELECT sample_id, """ + ", ".join(f"avg({f}) AS {f}, count({f}) AS n_{f}" for f in R.FIELDS) + """ FROM rated GROUP BY sample_id)
"""


def sheet(spark, sf_dir):
    event, user = F.col("event_id"), F.col("user_id")
    half = lambda k: 1 + (event * k % 9) / F.lit(2.0)
    slip = event % 11
    sn = F.when(slip == 0, "").when(slip == 1, "abc").when(slip == 2, "6").otherwise(F.replace(half(7).cast("string"), F.lit("."), F.lit(",")))
    q = F.when(event % 13 == 0, " ").otherwise(F.when(event % 997 % 20 == 0, 5.0 - (user % 7) / 2).when(event % 997 % 20 == 1, 1.0).otherwise(half(5)).cast("string"))
    placement = F.when(event % 3 == 0, (1 + event * 3 % 5).cast("string"))
    return read(spark, sf_dir, "events").select((user % 7).alias("rater"), (event % 997).alias("item"), sn.alias("sn"), q.alias("q"), (1 + event % 5).cast("string").alias("naturalness"), placement.alias("placement"))


def key(spark):
    item = F.col("id")
    kind = F.when(item % 20 == 0, "anchor_gt").when(item % 20 == 1, "anchor_degraded").otherwise("model")
    return spark.range(980).select(item.alias("item"), kind.alias("kind"), F.concat(F.lit("s"), item.cast("string")).alias("sample_id"), (item % 30).alias("speaker"))


def accepted(spark, sf_dir):
    rows = R.cleaned(sheet(spark, sf_dir))
    return R.of_accepted(rows, key(spark), R.anchors(rows, key(spark)))


@query("rating_sheet_clean", f"WITH {SHEET}, typed AS (SELECT rater, unnest([sn, q, naturalness, placement]) AS t FROM sheet) SELECT rater, count(*) AS cells, count(*) FILTER (trim(coalesce(t, '')) = '') AS blank, count(*) FILTER (trim(coalesce(t, '')) <> '' AND NOT coalesce(try_cast(replace(trim(t), ',', '.') AS DOUBLE) BETWEEN 1 AND 5, false)) AS problems FROM typed GROUP BY rater")
def rating_sheet_clean(spark, sf_dir):
    cells = sheet(spark, sf_dir).select("rater", F.explode(F.array(*R.FIELDS)).alias("t"))
    return cells.groupBy("rater").agg(F.count("*").alias("cells"), F.count_if(F.trim(F.coalesce("t", F.lit(""))) == "").alias("blank"), F.count_if(R.is_problem(F.col("t"))).alias("problems"))


@query("rating_problems", f"WITH {SHEET} SELECT rater, typed, count(*) AS n FROM clean WHERE sn IS NULL AND trim(typed) <> '' GROUP BY ALL")
def rating_problems(spark, sf_dir):
    return R.problems(sheet(spark, sf_dir)).where("field = 'sn'").groupBy("rater", "typed").agg(F.count("*").alias("n"))


@query("rater_anchor_check", f"""WITH {RATERS} SELECT rater, n_items, round(gt, 9) AS gt, round(degraded, 9) AS degraded, array_to_string(list_filter([CASE WHEN low THEN 'ground truth rated low' END, CASE WHEN no_gap THEN 'no gap to degraded' END], lambda x: x IS NOT NULL), '; ') AS reasons, accepted FROM raters""")
def rater_anchor_check(spark, sf_dir):
    judged = R.anchors(R.cleaned(sheet(spark, sf_dir)), key(spark))
    return judged.select("rater", "n_items", F.round("gt", 9).alias("gt"), F.round("degraded", 9).alias("degraded"), F.array_join("reasons", "; ").alias("reasons"), "accepted")


@query("rating_sample_means", f"WITH {RATERS} SELECT sample_id, " + ", ".join(f"round({f}, 9) AS {f}, n_{f}" for f in R.FIELDS) + ', sn IS NOT NULL AND q IS NOT NULL AS "both" FROM samples')
def rating_sample_means(spark, sf_dir):
    means = R.sample_means(accepted(spark, sf_dir))
    return means.select("sample_id", *[x for f in R.FIELDS for x in (F.round(f, 9).alias(f), F.col(f"n_{f}"))], "both")


def resampled_sql(rows: str, by: str, seed: int = 0, reps: int = 100, name: str = "ci") -> str:
    """CTEs up to one of that name (ci_low, ci_high, reps) over rows (by, key, num, den): n draws on blocks, then within them."""
    bits = lambda *parts: f"('0x' || substr(md5('{seed}|' || " + " || '|' || ".join(parts) + "), 1, 15))::BIGINT"
    return f"""{name}_placed AS (SELECT {by}, num, den, row_number() OVER (PARTITION BY {by} ORDER BY key, num, den) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {rows}),
{name}_dealt AS (SELECT {by}, n, rep, ({bits("rep", "i")} % n) // {stats.BLOCK} AS b, count(*) AS m FROM {name}_placed, (SELECT unnest(range({reps})) AS rep) GROUP BY ALL),
{name}_picked AS (SELECT {by}, rep, b * {stats.BLOCK} + {bits("rep", "b", "k")} % least({stats.BLOCK}, n - b * {stats.BLOCK}) AS i FROM (SELECT *, unnest(range(m)) AS k FROM {name}_dealt)),
{name}_sums AS (SELECT p.{by}, rep, sum(num)::DOUBLE / nullif(sum(den), 0) AS r FROM {name}_picked p JOIN {name}_placed q ON p.{by} IS NOT DISTINCT FROM q.{by} AND p.i = q.i GROUP BY ALL),
{name} AS (SELECT {by}, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS ci_high, count(r) AS reps FROM {name}_sums GROUP BY ALL)"""


@query("rating_summary", f"WITH {RATERS}, long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, sample_id AS key, {f} AS num, 1 AS den FROM samples WHERE {f} IS NOT NULL" for f in R.FIELDS) + "), " + resampled_sql("long", "field") + " SELECT field, n, round(mean, 9) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM (SELECT field, count(*) AS n, avg(num) AS mean FROM long GROUP BY field) JOIN ci USING (field)")
def rating_summary(spark, sf_dir):
    """Means of samples' means by field, with intervals."""
    one = R.summarised(R.sample_means(accepted(spark, sf_dir)))
    return one.select("field", "n", F.round("mean", 9).alias("mean"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


AGREE = RATERS + """, one AS (SELECT rater, sample_id, avg(sn) AS sn FROM rated WHERE sn IS NOT NULL GROUP BY ALL),
pairs AS (SELECT a.rater AS a, b.rater AS b, count(*) AS common, CASE WHEN count(*) >= 5 THEN covar_pop(a.sn, b.sn) / nullif(stddev_pop(a.sn) * stddev_pop(b.sn), 0) END AS pearson
  FROM one a JOIN one b ON a.sample_id = b.sample_id AND a.rater < b.rater GROUP BY ALL)
"""


@query("rater_agreement", f"WITH {AGREE} SELECT a, b, common, round(pearson, 6) AS pearson FROM pairs")
def rater_agreement(spark, sf_dir):
    return R.agreement(accepted(spark, sf_dir), "sn").withColumn("pearson", F.round("pearson", 6))


@query("mean_agreement", f"WITH {AGREE} SELECT count(pearson) AS pairs, round(avg(pearson), 6) AS pearson FROM pairs")
def mean_agreement(spark, sf_dir):
    return R.mean_agreement(R.agreement(accepted(spark, sf_dir), "sn")).withColumn("pearson", F.round("pearson", 6))


@query("unknown_items", f"WITH {SHEET} SELECT rater, count(*) AS unknown FROM clean WHERE NOT EXISTS (SELECT 1 FROM key WHERE key.item = clean.item) GROUP BY rater")
def unknown_items(spark, sf_dir):
    return R.unknown(R.cleaned(sheet(spark, sf_dir)), key(spark)).groupBy("rater").agg(F.count("*").alias("unknown"))


#: Component values by source, as a model's results would give them; some are missing.
PARTS = """parts AS (
  SELECT source, avg((n_chars % 97) / 96::DOUBLE) AS nvpa, avg((n_chars % 53) / 52::DOUBLE) AS wer, avg(CASE WHEN source <> 'src3' THEN 1 + 4 * ((n_chars % 401) / 400::DOUBLE) END) AS pmos,
    avg((n_chars % 31) / 15::DOUBLE - 1) AS ss, avg(CASE WHEN source <> 'src1' THEN 1 + (n_chars % 9) / 2::DOUBLE END) AS sn, avg(1 + (n_chars % 7) / 2::DOUBLE) AS q FROM documents GROUP BY source)"""
NAMES = ("nvpa", "wer", "pmos", "ss")


def parts(spark, sf_dir):
    n = F.col("n_chars")
    return read(spark, sf_dir, "documents").groupBy("source").agg(
        F.avg(n % 97 / 96).alias("nvpa"), F.avg(n % 53 / 52).alias("wer"), F.avg(F.when(F.col("source") != "src3", 1 + 4 * (n % 401 / 400))).alias("pmos"), F.avg(n % 31 / 15 - 1).alias("ss"),
        F.avg(F.when(F.col("source") != "src1", 1 + n % 9 / 2)).alias("sn"), F.avg(1 + n % 7 / 2).alias("q"),
    )


SHARES = {"nvpa": "nvpa", "wer": "(1 - least(wer, 1))", "pmos": "(pmos - 1) / 4", "ss": "greatest(ss, 0)", "sn": "(sn - 1) / 4", "q": "(q - 1) / 4"}


def auto_sql(t):
    return "(" + " + ".join(f"{scoring.WEIGHTS[t][k]}::DOUBLE * {SHARES[k]}" for k in NAMES) + ")"


@query("scores", f"WITH {PARTS} SELECT source, " + ", ".join(f"round({auto_sql(t)}, 9) AS auto_{t.lower()}, round({auto_sql(t)} + {scoring.WEIGHTS[t]['sn']}::DOUBLE * (sn - 1) / 4 + {scoring.WEIGHTS[t]['q']}::DOUBLE * (q - 1) / 4, 9) AS final_{t.lower()}" for t in "AB") + " FROM parts")
def scores(spark, sf_dir):
    out = [F.col("source")]
    for t in "AB":
        auto = scoring.automatic(t, *map(F.col, NAMES))
        out += [F.round(auto, 9).alias(f"auto_{t.lower()}"), F.round(scoring.final(t, auto, F.col("sn"), F.col("q")), 9).alias(f"final_{t.lower()}")]
    return parts(spark, sf_dir).select(*out)


@query("auto_score", f"WITH {PARTS} SELECT source, {auto_sql('A')} IS NOT NULL AS complete, round({auto_sql('A')} / 0.7::DOUBLE, 9) AS renormalized FROM parts")
def auto_score(spark, sf_dir):
    """The automatic score as a share of what it can reach; null where a component is missing."""
    auto = scoring.automatic("A", *map(F.col, NAMES))
    return parts(spark, sf_dir).select("source", auto.isNotNull().alias("complete"), F.round(scoring.renormalized("A", auto), 9).alias("renormalized"))


@query("partial_components", f"WITH {PARTS} " + " UNION ALL ".join(f"SELECT source, '{k}' AS component, {scoring.WEIGHTS['A'][k]}::DOUBLE AS weight, round({SHARES[k]}, 9) AS share, round({scoring.WEIGHTS['A'][k]}::DOUBLE * {SHARES[k]}, 9) AS contribution, {k} IS NULL AS missing FROM parts" for k in SHARES))
def partial_components(spark, sf_dir):
    """Every component with its weight, normalised value and contribution, the missing ones marked."""
    rows = scoring.breakdown("A", {k: F.col(k) for k in SHARES})
    return parts(spark, sf_dir).select("source", F.inline(rows)).withColumns({c: F.round(c, 9) for c in ("share", "contribution")})
