"""Events in tagged transcripts: inventories, matching with detections, sweeps, chance baselines."""

from pyspark.sql import functions as F

from murmura.operators import events as E
from murmura.operators import pairing, stats
from murmura.plans import fixtures as X
from murmura.plans.ratings import resampled_sql
from murmura.registry import query
from murmura.storage import kept

gold = X.gold


@query("parse_tags_events", f"WITH {X.GOLD} SELECT type, count(*) AS n, count(DISTINCT sample_id) AS samples, sum(gap)::BIGINT AS gaps FROM gold GROUP BY type")
def parse_tags_events(spark, sf_dir):
    return gold(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples"), F.sum("gap").alias("gaps"))


def sizes(spark, sf_dir):
    """speaker, n_words and events of every text; a text is parsed once."""
    return X.parsed(spark, sf_dir).where("error IS NULL").select("sample_id", "speaker", F.size("words").cast("long").alias("n_words"), "events")


@query("tag_inventory", f"""WITH {X.GOLD}, total AS (SELECT count(*) FILTER (type IS NULL) AS words, count(DISTINCT sample_id) AS samples FROM parsed)
SELECT type, count(*) AS n, round(100::DOUBLE * count(*) / any_value(words), 9) AS per_100_words, round(100::DOUBLE * count(DISTINCT sample_id) / any_value(samples), 9) AS percent_samples,
  count(*) FILTER (gap = 0) AS at_start, count(*) FILTER (gap > 0 AND gap < n_words) AS at_mid, count(*) FILTER (gap > 0 AND gap >= n_words) AS at_end FROM gold, total GROUP BY type""")
def tag_inventory(spark, sf_dir):
    """Words and samples come along as counts by type, so that texts are read once: every sample has a row of no type."""
    none = F.array(F.struct(F.lit(0).alias("e"), F.lit(None).cast("string").alias("type"), F.lit(0).alias("gap")))
    every = sizes(spark, sf_dir).where("n_words > 0 OR size(events) > 0").select("sample_id", "n_words", F.inline(F.concat("events", none)))
    place = E.position(F.col("gap"), F.col("n_words"))
    per = every.groupBy("type").agg(
        F.count("*").alias("n"), F.count_distinct("sample_id").alias("own"), F.sum("n_words").alias("words"), *[F.count_if(place == x).alias(f"at_{x}") for x in ("start", "mid", "end")]
    )
    total = per.where("type IS NULL").select("words", F.col("own").alias("samples"))  # one row
    by = per.where("type IS NOT NULL").drop("words").join(F.broadcast(total))
    return by.select("type", "n", F.round(F.try_divide(100.0 * F.col("n"), "words"), 9).alias("per_100_words"), F.round(F.try_divide(100.0 * F.col("own"), "samples"), 9).alias("percent_samples"), "at_start", "at_mid", "at_end")


@query("position_classes", f"WITH {X.GOLD} SELECT type, CASE WHEN gap = 0 THEN 'start' WHEN gap >= n_words THEN 'end' ELSE 'mid' END AS place, CASE WHEN n_words = 0 THEN 'only' WHEN gap = 0 THEN 'start' WHEN gap = n_words THEN 'end' ELSE 'mid' END AS place_or_only, count(*) AS n FROM gold GROUP BY ALL")
def position_classes(spark, sf_dir):
    own = [F.col("gap"), F.col("n_words")]
    return gold(spark, sf_dir).groupBy("type", E.position(*own).alias("place"), E.position_or_only(*own).alias("place_or_only")).agg(F.count("*").alias("n"))


@query("position_deciles", f"WITH {X.GOLD} SELECT least((gap * 10) // n_words, 9)::INT AS decile, count(*) AS n FROM gold WHERE n_words > 0 GROUP BY ALL")
def position_deciles(spark, sf_dir):
    return gold(spark, sf_dir).where("n_words > 0").groupBy(F.least(F.floor(F.col("gap") * 10 / F.col("n_words")), F.lit(9)).cast("int").alias("decile")).agg(F.count("*").alias("n"))


@query("events_per_gap", f"""WITH {X.GOLD}, each_gap AS (SELECT sample_id, gap, count(*) AS events, count(DISTINCT type) AS types FROM gold GROUP BY ALL), each_text AS (SELECT sample_id, count(*) AS events, count(DISTINCT type) AS types FROM gold GROUP BY ALL)
SELECT 'gap' AS per, events, types, count(*) AS n FROM each_gap GROUP BY ALL UNION ALL SELECT 'text', events, types, count(*) FROM each_text GROUP BY ALL""")
def events_per_gap(spark, sf_dir):
    """How many events, and of how many types, a gap and a text have, without a bound."""
    own = gold(spark, sf_dir)
    per_gap = own.groupBy("sample_id", "gap").agg(F.count("*").alias("events"), F.collect_set("type").alias("kinds"))
    per_text = per_gap.groupBy("sample_id").agg(F.sum("events").alias("events"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"))
    shape = lambda df, per, events: df.groupBy(F.lit(per).alias("per"), events.alias("events"), F.size("kinds").cast("long").alias("types")).agg(F.count("*").alias("n"))
    return shape(per_gap, "gap", F.col("events")).union(shape(per_text, "text", F.col("events")))


@query("threshold_sweep", f"""WITH {X.FOUND}, grid AS (SELECT unnest([0.5, 0.75, 1.0, 1.25])::DOUBLE AS scale)
SELECT scale, type, count(*) FILTER (prob >= least(base * scale, 1)) AS fired FROM found JOIN base USING (type), grid GROUP BY ALL""")
def threshold_sweep(spark, sf_dir):
    found = X.detected(gold(spark, sf_dir)).join(F.broadcast(X.thresholds(spark)), "type")
    points = F.array(*[F.lit(s) for s in (0.5, 0.75, 1.0, 1.25)])
    many = found.groupBy("type", "base", F.round(F.col("prob"), 6).alias("prob")).count().withColumn("scale", F.explode(points))  # counts by probability, not rows
    fires = F.col("prob") >= E.threshold(F.col("base"), F.col("scale"))
    return many.groupBy("scale", "type").agg(F.sum(F.when(fires, F.col("count")).otherwise(0)).alias("fired"))


@query("band_join", f"WITH {X.FOUND} SELECT g.type, f.gap - g.gap AS shift, count(*) AS n FROM gold g JOIN found f ON g.sample_id = f.sample_id AND g.type = f.type AND f.gap - g.gap BETWEEN -1 AND 2 GROUP BY ALL")
def band_join(spark, sf_dir):
    events = X.gold_stored(spark, sf_dir)
    return E.banded(events, X.detected(events), 1, 2).groupBy("type", (F.col("found") - F.col("gap")).alias("shift")).agg(F.count("*").alias("n"))


NEAREST = X.FOUND + """, nearest AS (
  SELECT g.sample_id, g.e, any_value(g.type) AS type, arg_min(f.gap - g.gap, abs(f.gap - g.gap) * 2 + (f.gap > g.gap)::INT) AS shift
  FROM gold g LEFT JOIN found f ON g.sample_id = f.sample_id AND g.type = f.type AND f.gap - g.gap BETWEEN -5 AND 5 GROUP BY g.sample_id, g.e)
"""


@query("offset_histogram", f"WITH {NEAREST} SELECT type, shift, count(*) AS n FROM nearest GROUP BY GROUPING SETS ((shift), (type, shift))")
def offset_histogram(spark, sf_dir):
    events = X.gold_stored(spark, sf_dir)
    nearest = E.offsets(events, X.detected(events))
    return nearest.groupingSets([["shift"], ["type", "shift"]], "type", "shift").agg(F.count("*").alias("n")).select("type", "shift", "n")


#: Tolerance: as early as the event, or one word later.
BEFORE, AFTER = E.tolerance("0:1")


def detections(spark, events):
    """All detections, and those that fire, with the tolerance."""
    found = kept(X.detected(events))
    return found, E.with_tolerance(E.fired(found, X.thresholds(spark)), BEFORE, AFTER)


def outcomes(spark, sf_dir):
    events = X.gold_stored(spark, sf_dir)
    found, fired = detections(spark, events)
    return E.judged(events, fired, found)


def hit_counts(spark, sf_dir):
    """Hits and events of every sample; detections are read once here, so they aren't kept."""
    events = kept(gold(spark, sf_dir).select("sample_id", "e", "type", "gap"))
    return E.hit_counts(events, E.with_tolerance(E.fired(X.detected(events), X.thresholds(spark)), BEFORE, AFTER))


OUTCOMES = X.FOUND + "," + X.greedy("gold", "fired") + """,
judged AS (SELECT g.*, h.found - g.gap AS "offset", h.e IS NOT NULL AS hit, CASE WHEN h.e IS NOT NULL THEN 'ok'
    WHEN EXISTS (SELECT 1 FROM fired f WHERE f.sample_id = g.sample_id AND f.type <> g.type AND f.gap - g.gap BETWEEN 0 AND 1) THEN 'wrong_type'
    WHEN EXISTS (SELECT 1 FROM fired f WHERE f.sample_id = g.sample_id AND f.type = g.type AND f.gap - g.gap NOT BETWEEN 0 AND 1) THEN 'wrong_position' ELSE 'missing' END AS reason,
    (SELECT max(prob) FROM fired f WHERE f.sample_id = h.sample_id AND f.type = h.type AND f.gap = h.found) AS own_prob, (SELECT max(prob) FROM found f WHERE f.sample_id = g.sample_id AND f.type = g.type AND f.gap = g.gap) AS at_gap
  FROM gold g LEFT JOIN hits h ON g.sample_id = h.sample_id AND g.e = h.e),
left_over AS (SELECT * FROM fired f WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.sample_id = f.sample_id AND h.type = f.type AND h.found = f.gap))
"""


@query("placement_reasons", f"WITH {OUTCOMES} SELECT type, reason, \"offset\", count(*) AS n, round(avg(coalesce(own_prob, at_gap)), 9) AS prob FROM judged GROUP BY ALL")
def placement_reasons(spark, sf_dir):
    """Reasons and offsets of hits by type, with the mean probability of the detection taken, or at the event's own gap."""
    return outcomes(spark, sf_dir).groupBy("type", "reason", "offset").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 9).alias("prob"))


@query("placement_summary", f"""WITH {OUTCOMES}, by_type AS (SELECT type, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (reason = 'wrong_type') AS wrong FROM judged GROUP BY type),
by_speaker AS (SELECT speaker, count(*) AS n, count(*) FILTER (hit) AS hits FROM judged GROUP BY speaker)
SELECT sum(n)::BIGINT AS n, sum(hits)::DOUBLE / sum(n) AS micro, round(avg(hits::DOUBLE / n), 9) AS macro_type, (sum(hits) + sum(wrong))::DOUBLE / sum(n) AS detection_rate, sum(hits)::DOUBLE / (sum(hits) + sum(wrong)) AS type_accuracy,
  (SELECT round(avg(hits::DOUBLE / n), 9) FROM by_speaker) AS macro_speaker, (SELECT count(*) FROM left_over) AS spurious,
  round(100::DOUBLE * (SELECT count(*) FROM left_over) / (SELECT count(*) FILTER (type IS NULL) FROM parsed), 9) AS per_100_words FROM by_type""")
def placement_summary(spark, sf_dir):
    texts = kept(sizes(spark, sf_dir))  # parsed once, for its words and its events
    events = texts.select("sample_id", "speaker", "n_words", F.inline("events")).withColumn("gap", F.col("gap").cast("long"))
    found, fired = detections(spark, events)
    both = kept(pairing.compared(events, fired, found))
    one = E.summarised(pairing.outcomes(both, events.columns), pairing.left_over(both), texts.agg(F.sum("n_words").alias("n_words")))
    return one.withColumns({c: F.round(c, 9) for c in ("macro_type", "macro_speaker", "per_100_words")})


@query("placement_by_position", f"WITH {OUTCOMES} SELECT CASE WHEN gap = 0 THEN 'start' WHEN gap >= n_words THEN 'end' ELSE 'mid' END AS place, count(*) AS n, count(*) FILTER (hit)::DOUBLE / count(*) AS accuracy FROM judged GROUP BY ALL")
def placement_by_position(spark, sf_dir):
    by = outcomes(spark, sf_dir).groupBy(E.position(F.col("gap"), F.col("n_words")).alias("place"))
    return by.agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("accuracy"))


#: Replicates of intervals by type.
REPLICATES = 500


@query("placement_intervals", f"WITH {OUTCOMES}, x AS (SELECT type, {{'a': sample_id, 'b': e}} AS key, hit::INT AS num, 1 AS den, speaker FROM judged), y AS (SELECT type, speaker AS key, sum(num) AS num, sum(den) AS den FROM x GROUP BY ALL), {resampled_sql('x', 'type', 6, REPLICATES)}, {resampled_sql('y', 'type', 6, REPLICATES, 'cl')} SELECT x.type, count(*) AS n, round(avg(num), 9) AS value, round(any_value(ci.ci_low), 6) AS ci_low, round(any_value(ci.ci_high), 6) AS ci_high, any_value(k.clusters) AS clusters, round(any_value(cl.ci_low), 6) AS cluster_low, round(any_value(cl.ci_high), 6) AS cluster_high FROM x JOIN ci USING (type) JOIN cl USING (type) JOIN (SELECT type, count(*) AS clusters FROM y GROUP BY type) k USING (type) GROUP BY x.type")
def placement_intervals(spark, sf_dir):
    """Accuracy by type with intervals over events and over speakers."""
    rows = outcomes(spark, sf_dir).select("type", F.struct(F.col("sample_id").alias("a"), F.col("e").alias("b")).alias("key"), F.col("hit").cast("int").alias("num"), F.lit(1).alias("den"), "speaker")
    return stats.rounded(stats.intervals(rows, ["type"], reps=REPLICATES, seed=6))


@query("placement_spurious", f"WITH {OUTCOMES} SELECT type, count(*) AS spurious FROM left_over GROUP BY type")
def placement_spurious(spark, sf_dir):
    """Detections that fired and that no event took."""
    events = X.gold_stored(spark, sf_dir)
    return E.spurious(events, detections(spark, events)[1]).groupBy("type").agg(F.count("*").alias("spurious"))


SCALES, TOLERANCES = [0.5, 0.75, 1.0, 1.25], [E.tolerance(x) for x in ("0", "1", "2", "3", "0:1")]
#: Draws of a gap: the same as stats.drawn gives.
DRAWN = "('0x' || substr(md5('{seed}|' || rep || '|' || sample_id || '|' || e), 1, 8))::BIGINT % (n_words + 1)"
ANEW = "anew AS (SELECT sample_id, type, e, rep, " + DRAWN.format(seed=0) + " AS gap FROM gold, (SELECT unnest(range({reps})) AS rep))"
POINTS = "points AS (SELECT scale, b.b AS before, b.a AS after FROM (SELECT unnest([0.5, 0.75, 1.0, 1.25])::DOUBLE AS scale), (SELECT unnest([{'b': 0, 'a': 0}, {'b': 1, 'a': 1}, {'b': 2, 'a': 2}, {'b': 3, 'a': 3}, {'b': 0, 'a': 1}]) AS b))"
GRID = X.FOUND + "," + POINTS + """,
grid AS (SELECT scale, before, after, found.* FROM found JOIN base USING (type), points WHERE prob >= least(base * scale, 1)),
""" + ANEW.format(reps=2)


def at_points(events: str, rep: str = "") -> str:
    """The matching at every point, as greedy gives it."""
    keys, reach = f"scale, before, after{rep}", "BETWEEN -before AND after"
    return X.greedy(events, "grid", keys, reach)


@query("tolerance_sweep", f"""WITH {GRID}, {at_points('gold')},
scored AS (SELECT scale, before, after, type, count(*) AS hits FROM hits GROUP BY ALL), seen AS (SELECT scale, before, after, type, count(*) AS seen FROM grid GROUP BY ALL), n AS (SELECT type, count(*) AS n FROM gold GROUP BY type),
kinds AS (SELECT type FROM gold UNION SELECT type FROM found),
rolled AS (SELECT scale, before, after, type, sum(coalesce(n, 0))::BIGINT AS n, sum(coalesce(hits, 0))::BIGINT AS hits, sum(coalesce(seen, 0) - coalesce(hits, 0))::BIGINT AS spurious
  FROM points CROSS JOIN kinds LEFT JOIN n USING (type) LEFT JOIN scored USING (scale, before, after, type) LEFT JOIN seen USING (scale, before, after, type) GROUP BY GROUPING SETS ((scale, before, after), (scale, before, after, type)))
SELECT scale, before, after, type, n, hits, hits::DOUBLE / n AS accuracy, spurious FROM rolled""")
def tolerance_sweep(spark, sf_dir):
    """All points of the grid by type and over all types, from one pass over the detections."""
    events = X.gold_stored(spark, sf_dir)
    return E.sweep(events, X.detected(events), X.thresholds(spark), SCALES, TOLERANCES, reps=0).drop(*E.MISSES)


@query("sweep_reasons", f"""WITH {GRID}, {at_points('gold')},
judged_at AS (SELECT p.scale, p.before, p.after, g.type, CASE WHEN h.e IS NOT NULL THEN 'ok'
    WHEN EXISTS (SELECT 1 FROM grid f WHERE f.scale = p.scale AND f.before = p.before AND f.after = p.after AND f.sample_id = g.sample_id AND f.type <> g.type AND f.gap - g.gap BETWEEN -p.before AND p.after) THEN 'wrong_type'
    WHEN EXISTS (SELECT 1 FROM grid f WHERE f.scale = p.scale AND f.before = p.before AND f.after = p.after AND f.sample_id = g.sample_id AND f.type = g.type AND f.gap - g.gap NOT BETWEEN -p.before AND p.after) THEN 'wrong_position' ELSE 'missing' END AS reason
  FROM points p CROSS JOIN gold g LEFT JOIN hits h ON h.scale = p.scale AND h.before = p.before AND h.after = p.after AND h.sample_id = g.sample_id AND h.e = g.e WHERE p.scale = 0.75)
SELECT scale, before, after, type, count(*) FILTER (reason = 'ok') AS hits, count(*) FILTER (reason = 'wrong_type') AS wrong_type, count(*) FILTER (reason = 'wrong_position') AS wrong_position, count(*) FILTER (reason = 'missing') AS missing FROM judged_at GROUP BY ALL""")
def sweep_reasons(spark, sf_dir):
    """Why events are missed at every tolerance, by type, at one scale."""
    events = X.gold_stored(spark, sf_dir)
    every = E.sweep(events, X.detected(events), X.thresholds(spark), [0.75], TOLERANCES, reps=0).where("type IS NOT NULL AND n > 0")
    return every.select(*E.POINT, "type", "hits", "wrong_type", "wrong_position", "missing")


@query("shuffle_baseline", "WITH " + X.FOUND + "," + ANEW.format(reps=20) + "," + X.greedy("anew", "fired", "rep") + """,
rates AS (SELECT rep, count(e)::DOUBLE / (SELECT count(*) FROM gold) AS r FROM (SELECT unnest(range(20)) AS rep) LEFT JOIN hits USING (rep) GROUP BY rep)
SELECT count(r) AS reps, round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS std, min(r) AS low, max(r) AS high FROM rates""")
def shuffle_baseline(spark, sf_dir):
    """Accuracy of events in gaps drawn by chance against the same detections, over twenty replicates."""
    events = X.gold_stored(spark, sf_dir)
    one = E.baseline(events, detections(spark, events)[1], BEFORE, AFTER, 20, 0)
    return one.withColumns({c: F.round(c, 9) for c in ("mean", "std")})


@query("tolerance_check", "WITH " + X.FOUND + ", points AS (SELECT 0.75::DOUBLE AS scale, b.b AS before, b.a AS after FROM (SELECT unnest([{'b': 0, 'a': 0}, {'b': 0, 'a': 1}, {'b': 2, 'a': 2}]) AS b)), grid AS (SELECT scale, before, after, found.* FROM found JOIN base USING (type), points WHERE prob >= least(base * scale, 1)), "
  + at_points("gold") + """, lost AS (SELECT before, after, count(*) AS lost FROM points CROSS JOIN gold g WHERE (g.sample_id + g.e) % 6 = 0 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.before = points.before AND h.after = points.after AND h.sample_id = g.sample_id AND h.e = g.e)
  AND NOT EXISTS (SELECT 1 FROM grid f WHERE f.before = points.before AND f.after = points.after AND f.sample_id = g.sample_id AND f.type <> g.type AND f.gap - g.gap BETWEEN -points.before AND points.after) GROUP BY ALL),
scored AS (SELECT before, after, count(*) AS hits FROM hits GROUP BY ALL), seen AS (SELECT before, after, count(*) AS seen FROM grid GROUP BY ALL)
SELECT before, after, (SELECT count(*) FROM gold) - lost AS n, hits, round(hits::DOUBLE / ((SELECT count(*) FROM gold) - lost), 9) AS accuracy, seen - hits AS spurious, before = 0 AND after = 1 AS chosen FROM scored JOIN seen USING (before, after) JOIN lost USING (before, after)""")
def tolerance_check(spark, sf_dir):
    """The chosen tolerance beside none and two, without the events whose gap (of every sixth) is unusable and that nothing else explains."""
    events = X.gold_stored(spark, sf_dir).withColumn("valid", (F.col("sample_id") + F.col("e")) % 6 != 0)
    every = E.tolerance_check(events, X.detected(events), X.thresholds(spark), 0.75, BEFORE, AFTER, 2, 0, "exclude")
    return every.select("before", "after", "n", "hits", F.round("accuracy", 9).alias("accuracy"), "spurious", "chosen")


@query("sweep_lift", "WITH " + GRID + "," + at_points("anew", ", rep") + ", chance AS (SELECT scale, before, after, avg(h) AS h FROM (SELECT scale, before, after, rep, count(e)::DOUBLE AS h FROM points CROSS JOIN (SELECT unnest(range(2)) AS rep) LEFT JOIN hits USING (scale, before, after, rep) GROUP BY ALL) GROUP BY ALL), "
  + at_points("gold").replace("pairs", "g_pairs").replace("ordered", "g_ordered").replace("taken", "g_taken").replace("hits", "g_hits") + """,
own AS (SELECT scale, before, after, count(*)::DOUBLE AS hits FROM g_hits GROUP BY ALL)
SELECT scale, before, after, round(hits / (SELECT count(*) FROM gold), 9) AS accuracy, round(h / (SELECT count(*) FROM gold), 9) AS baseline, round((hits - h) / (SELECT count(*) FROM gold), 9) AS lift FROM own JOIN chance USING (scale, before, after)""")
def sweep_lift(spark, sf_dir):
    """Accuracy over all types at every point of the grid, beside what chance reaches there."""
    events = X.gold_stored(spark, sf_dir)
    every = E.sweep(events, X.detected(events), X.thresholds(spark), SCALES, TOLERANCES, reps=2).where("type IS NULL")
    return every.select(*E.POINT, *[F.round(c, 9).alias(c) for c in ("accuracy", "baseline", "lift")])
