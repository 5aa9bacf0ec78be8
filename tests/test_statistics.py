"""Statistics, ratings and subsets on random cases, worked out by hand."""

import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions import scoring
from murmura.operators import ratings as R
from murmura.operators import report, stats, vectors
from murmura.operators import subset as S


def test_described(spark):
    rng = random.Random(1)
    groups = {g: [rng.randrange(20) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 37), ("d", 100))}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [("a", None)], "g string, x int")
    for r in stats.described(df, ["g"], "x").collect():
        own = groups[r.g]
        assert (r.n, r.low, r.high) == (len(own), min(own), max(own))
        assert r.mean == pytest.approx(statistics.fmean(own)) and r.std == pytest.approx(statistics.pstdev(own))
        assert [r[f"p{q}"] for q in (5, 25, 50, 75, 95)] == pytest.approx([float(np.percentile(own, q)) for q in (5, 25, 50, 75, 95)])


def test_spearman(spark):
    rng = random.Random(2)
    rows = [("a", rng.randrange(9), rng.randrange(5)) for _ in range(80)] + [("b", 1, 2), ("b", 2, 1)] + [("c", k, 3) for k in range(6)] + [("a", None, 1)]
    got = {r.g: (r.n, r.rho) for r in stats.spearman(spark.createDataFrame(rows, "g string, x int, y int"), ["g"], "x", "y").collect()}
    rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
    own = [(x, y) for g, x, y in rows if g == "a" and x is not None]
    assert got["a"] == (80, pytest.approx(statistics.correlation(rank([x for x, _ in own]), rank([y for _, y in own]))))
    assert got["b"] == (2, None) and got["c"] == (6, None)


def draw(seed, *counter):
    return int(hashlib.md5("|".join(map(str, (seed, *counter))).encode()).hexdigest()[:15], 16)


def test_running_sums_of_a_group_in_many_tasks(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([None, *range(300)]), k) for g, n in (("hot", 3000), ("a", 5), (None, 40)) for k in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, x int, k int")
        got = stats.running(df, ["g"], ["x", "k"], F.col("k") % 3)
        assert "_part" not in got.columns
        found = {(r.g, r.x, r.k): (r.cum, r.total) for r in got.collect()}
        tasks = df.repartitionByRange("g", "x", "k").withColumn("p", F.spark_partition_id()).where("g = 'hot'").select("p").distinct().count()
        deep = stats.described(df, ["g"], "x").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
    for g in ("hot", "a", None):
        own, cum = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2])), 0
        for r in own:
            cum += r[2] % 3
            assert found[r] == (cum, sum(x[2] % 3 for x in own))
        values = [r[1] for r in own if r[1] is not None]
        one = next(r for r in deep if r.g == g)
        assert (one.n, one.low, one.high) == (len(values), min(values), max(values)) and one.p75 == pytest.approx(np.percentile(values, 75)) and one.std == pytest.approx(statistics.pstdev(values))


def test_resampled(spark):
    """Every replicate has exactly as many draws as its group has rows, those of the hashes."""
    rng = random.Random(3)
    rows = [(g, k, rng.random(), rng.randrange(3)) for g, n in (("a", 60), ("b", 1), (None, 30), ("two", 2), ("big", 2500)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, key int, num double, den int")
    sums = {(r.g, r.rep): r for r in stats.replicates(df, ["g"], 20, 5).collect()}
    assert len(sums) == 100 and all(r.drawn == r.n == sum(x[0] == g for x in rows) for (g, _), r in sums.items())
    got = {r.g: r for r in stats.resampled(df, ["g"], 20, 5).collect()}
    for g in ("a", None, "two", "big"):
        own = [r[2:] for r in rows if r[0] == g]
        n, ratios = len(own), []
        for rep in range(20):
            blocks = [0] * (n // 1024 + 1)
            for i in range(n):
                blocks[draw(5, rep, i) % n // 1024] += 1
            picks = [b * 1024 + draw(5, rep, b, k) % min(1024, n - b * 1024) for b, m in enumerate(blocks) for k in range(m)]
            num, den = sum(own[i][0] for i in picks), sum(own[i][1] for i in picks)
            assert (sums[g, rep].num, sums[g, rep].den) == (pytest.approx(num), den)
            ratios += [num / den] if den else []
        assert got[g].value == pytest.approx(sum(x for x, _ in own) / sum(d for _, d in own)) and got[g].reps == len(ratios)
        assert (got[g].ci_low, got[g].ci_high) == pytest.approx((np.percentile(ratios, 2.5), np.percentile(ratios, 97.5)))
    assert got["b"].ci_low is None and got["b"].n == 1
    with_clusters = {r.g: r for r in stats.intervals(df.withColumn("speaker", F.col("key") % 7), ["g"], reps=20, seed=5).collect()}
    assert (with_clusters["a"].clusters, with_clusters["two"].clusters, with_clusters["b"].cluster_low) == (7, 2, None) and with_clusters["a"].ci_low == got["a"].ci_low
    assert stats.replicates(df.limit(0), [], 3, 1).collect() == []


def test_intervals_hold_the_mean_and_widen_with_clusters(spark):
    rng = random.Random(4)
    rows = [(c, c * 100 + k, c % 5 + rng.gauss(0, 0.1)) for c in range(12) for k in range(30)]
    df = spark.createDataFrame(rows, "c int, key int, num double").withColumn("den", F.lit(1))
    one = stats.resampled(df, [], 200, 0).first()
    by = stats.bootstrap(df.groupBy("c").agg(F.sum("num").alias("num"), F.sum("den").alias("den")), 200, 0).first()
    assert one.ci_low < one.value < one.ci_high and by.ci_high - by.ci_low > 2 * (one.ci_high - one.ci_low)
    assert stats.bootstrap(df.where("c = 0").groupBy("c").agg(F.sum("num").alias("num"), F.sum("den").alias("den")), 20, 0).first().ci_low is None


def test_group_statistics(spark):
    df = spark.createDataFrame([(k, "a" if k < 12 else None, float(k) if k % 4 else float("nan")) for k in range(20)], "key int, g string, x double")
    got = {r.g: r for r in stats.grouped(df, "g", "x", "key").collect()}
    assert (got["a"].n, got["a"].n_missing, got["a"].low_n) == (9, 3, True) and (got["None"].n, got["None"].n_missing) == (6, 2)
    assert got["a"].mean == pytest.approx(statistics.fmean(k for k in range(12) if k % 4))


def test_ratings(spark):
    rng = random.Random(5)
    kinds = ["anchor_gt"] * 3 + ["anchor_degraded"] * 3 + ["model"] * 14
    key = spark.createDataFrame([(i, k, f"s{i % 17}", "x") for i, k in enumerate(kinds)], "item long, kind string, sample_id string, speaker string")
    raw = []
    for rater in "abcd":
        for i, k in enumerate([*kinds, "model"]):
            level = {"anchor_gt": 5, "anchor_degraded": 1, "model": 3}[k] if rater != "d" else rng.choice([2, 3])
            raw.append((rater, i, level if rng.random() < 0.9 else None, rng.choice([1, 2, 3, 4, 5]) if k == "model" else level, None, rng.choice([None, 4])))
    rows = spark.createDataFrame([(a, b, *[None if x is None else float(x) for x in v]) for a, b, *v in raw], "rater string, item long, sn double, q double, naturalness double, placement double")
    judged = {r.rater: r for r in R.anchors(rows, key).collect()}
    mean = lambda v: statistics.fmean(x for x in v if x is not None) if any(x is not None for x in v) else None
    for rater in "abcd":
        of = {k: [mean([sn, q]) for r, i, sn, q, *_ in raw if r == rater and i < 20 and kinds[i] == k] for k in set(kinds)}
        gt, low = mean(of["anchor_gt"]), mean(of["anchor_degraded"])
        assert judged[rater].gt == pytest.approx(gt) and judged[rater].accepted == (gt >= 3 and gt - low >= 0.5) and judged[rater].n_items == 20
    assert not judged["d"].accepted and judged["d"].reasons and R.anchors(rows, key, exclude=False).where("accepted").count() == 4
    assert R.unknown(rows, key).count() == 4
    rated = R.of_accepted(rows, key, R.anchors(rows, key))
    means = {r.sample_id: r for r in R.sample_means(rated).collect()}
    good = [x for x in raw if judged[x[0]].accepted and x[1] < 20 and kinds[x[1]] == "model"]
    for s in {f"s{x[1] % 17}" for x in good}:
        own = [x for x in good if f"s{x[1] % 17}" == s]
        assert means[s].sn == pytest.approx(mean([x[2] for x in own])) and means[s].n_sn == sum(x[2] is not None for x in own) and means[s].q == pytest.approx(mean([x[3] for x in own]))
    pairs = R.agreement(rated, "q").collect()
    assert {(r.a, r.b) for r in pairs} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert R.mean_agreement(R.agreement(rated, "q")).first().pearson == pytest.approx(statistics.fmean(r.pearson for r in pairs))
    assert {r.field for r in R.summarised(R.sample_means(rated)).collect()} == {"sn", "q", "placement"}


def given(spark, sizes, total):
    return {r.stratum: r.given for r in S.quotas(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), total).collect()}


def rounds(sizes, total):
    """The rule as exact fractions of each round, by sorting strata on what a round gives them."""
    out = {k: 0 for k in sizes}
    for _ in range(1000):
        left = min(total, sum(sizes.values())) - sum(out.values())
        if left == 0:
            return out
        weight = {k: (sizes[k] - out[k]) ** 0.5 for k in sorted(sizes)}
        share = {k: left * w / sum(weight.values()) for k, w in weight.items()}
        step = {k: min(int(share[k]), sizes[k] - out[k]) for k in share}
        if sum(step.values()) == 0:
            winners = sorted((k for k in share if share[k] > 0), key=lambda k: (-share[k], k))[:left]
            step = {k: int(k in winners) for k in share}
        out = {k: out[k] + step[k] for k in out}
    raise AssertionError


def test_quotas(spark):
    assert given(spark, {"a": 100, "b": 100}, 20) == {"a": 10, "b": 10}
    assert given(spark, {"a": 2, "b": 50}, 100) == {"a": 2, "b": 50}
    assert given(spark, {"a": 400, "b": 100}, 30) == {"a": 20, "b": 10}
    assert given(spark, {}, 4) == {} and given(spark, {"a": 5}, 0) == {"a": 0}
    rng = random.Random(4)
    for sizes, total in (({"a": 400, "b": 100, "c": 1}, 31), ({"a": 7, "b": 7, "c": 7}, 5), *[({str(k): rng.randrange(1, 10 ** rng.randrange(1, 5)) for k in range(rng.randrange(1, 9))}, rng.randrange(1, 3000)) for _ in range(25)]):
        got = given(spark, sizes, total)
        assert sum(got.values()) == min(total, sum(sizes.values())) and got == rounds(sizes, total)


def test_subset(spark):
    rng = random.Random(6)
    rows = [(i, f"p{min(rng.randrange(12), rng.randrange(12))}", ["c"] * rng.randrange(4) + (["r"] if i % 31 == 0 else []) + (["q"] if i % 57 == 0 else []), rng.choice([None, 5.0, 20.0]), rng.randrange(100)) for i in range(400)]
    samples = spark.createDataFrame(rows, "sample_id long, speaker string, types array<string>, seconds double, n_words long")
    got = S.selected(samples, 50, 3).collect()
    md5 = lambda x: hashlib.md5(f"3|{x}".encode()).hexdigest()
    rare = sorted((r for r in rows if {"r", "q"} & set(r[2])), key=lambda r: (-len([t for t in r[2] if t in "rq"]), md5(r[0]), r[0]))
    want = [next(r for r in rare if "q" in r[2])]
    want.append(next(r for r in rare if "r" in r[2] and r not in want))
    want += [r for r in rare if r not in want][: 25 - len(want)]
    assert {g.sample_id for g in got if g.part == "rare"} == {r[0] for r in want}
    many = {p: sum(r[1] == p for r in rows) for p in {r[1] for r in rows}}
    strata = {}
    for r in rows:
        if r not in want:
            long_ = r[3] >= 15 if r[3] is not None else r[4] >= 50
            strata.setdefault(f"{'head' if many[r[1]] >= 20 else 'tail'}_{'long' if long_ else 'short'}", []).append(r)
    quotas = rounds({k: len(v) for k, v in strata.items()}, 50 - len(want))
    for name, pool in strata.items():
        turn = {}
        ordered = []
        for r in sorted(pool, key=lambda r: md5(r[0])):
            turn[r[1]] = turn.get(r[1], 0) + 1
            ordered.append((turn[r[1]], md5(r[1]), r[0]))
        assert {g.sample_id for g in got if g.part == name} == {x[2] for x in sorted(ordered)[: quotas[name]]}
    assert len(got) == len({g.sample_id for g in got}) == 50
    chosen = S.selected(samples, 50, 3)
    assert S.composition(samples, chosen).first().samples == 50
    items = S.package(samples, chosen, 4, 3, 3).collect()
    assert sorted(i["item"] for i in items) == [f"item_{k:04d}" for k in range(1, 58)]
    assert not {i.sample_id for i in items if i.kind != "model"} & {g.sample_id for g in got}
    everyone = S.selected(samples, 1000, 3)
    assert everyone.count() == 400 and S.anchor_pool(samples, everyone).count() == 400


def test_similarity(spark):
    rng = np.random.default_rng(7)
    own = rng.standard_normal((12, 6))
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    clips = spark.createDataFrame([(i, u.tolist(), 2.0) for i, u in enumerate(unit)], "clip long, u array<double>, seconds double")
    wanted = [(100, [0, 1, 2]), (101, [3]), (102, [4, 77]), (103, [])]
    samples = spark.createDataFrame([(s, unit[s % 12].tolist(), r) for s, r in wanted] + [(104, None, [1])], "sample_id long, u array<double>, refs array<long>")
    for mode in ("centroid", "mean_cosine"):
        got = {r.sample_id: r for r in vectors.similarity(samples, clips, mode).collect()}
        for s, refs in wanted[:2]:
            centre = unit[refs].mean(0)
            want = unit[s % 12] @ centre / (np.linalg.norm(centre) if mode == "centroid" else 1)
            assert got[s].cosine == pytest.approx(want) and got[s].n_ref_clips == len(refs) and got[s].ref_seconds == 2.0 * len(refs) and got[s].error is None
        assert (got[102].error, got[103].error, got[104].error) == ("missing reference", "missing reference", "no embedding")
    assert {r.sample_id: r.n_ref_clips for r in vectors.similarity(samples, clips, most=2).collect()}[100] == 2


def test_summary(spark):
    parts = spark.createDataFrame([(i, "x", i % 3, 4, i % 2, 10, 3.0, 0.5) for i in range(12)], "sample_id long, speaker string, hits int, events int, errors int, ref_words int, pmos double, cosine double")
    human = spark.createDataFrame([(i, 4.0, 3.0, float(1 + i % 3)) for i in range(6)] + [(99, 4.0, 3.0, None)], "sample_id long, sn double, q double, placement double")
    one = report.summary(parts, human).first()
    w = scoring.WEIGHTS["A"]
    auto = w["nvpa"] * 0.25 + w["wer"] * 0.95 + w["pmos"] * 0.5 + w["ss"] * 0.5
    assert one["auto"] == pytest.approx(auto) and one["final"] == pytest.approx(auto + w["sn"] * 0.75 + w["q"] * 0.5)
    assert (one["n_rated"], one["n_subset"], one["n_common"], one["rho"]) == (7, 6, 6, pytest.approx(1.0)) and one["missing_auto"] == ""
    none = report.summary(parts.withColumn("pmos", F.lit(None).cast("double")), human.where("sample_id > 50")).first()
    assert none["auto"] is None and none["missing_auto"] == "pmos" and "nvpa_rated" in none["missing_final"] and none["rho"] is None
    assert "auto" in report.lines(one.asDict()) and report.table([{"a": 1.0, "b": None}]).splitlines()[1].split() == ["1.0000", "–"]
