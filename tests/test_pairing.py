"""Pairs taken in order, grids against single points, alignment in pieces, intervals of a summary."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmura.operators import align, pairing, report
from murmura.operators import events as E


def test_taken_is_one_after_another():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        event, found, order = rng.integers(0, 8, n), rng.integers(0, 8, n), rng.permutation(n)
        used, want = (set(), set()), set()
        for p in order.tolist():
            if event[p] not in used[0] and found[p] not in used[1]:
                used[0].add(event[p])
                used[1].add(found[p])
                want.add(p)
        assert set(pairing.taken(event, found, order, 8, 8).tolist()) == want


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    gold = [(s, f"p{s % 3}", rng.choice("hsx"), rng.randrange(30), 30, e, rng.random() < 0.7) for s in range(40) for e in range(rng.randrange(8))]
    found = [(s, g, t, rng.choice([0.2, 0.4, 0.6, 0.8, 1.0])) for s in range(3, 44) for t in "hsy" for g in rng.sample(range(30), rng.randrange(6))]
    return (
        spark.createDataFrame(gold, "sample_id long, speaker string, type string, gap long, n_words long, e int, valid boolean"), spark.createDataFrame(found, "sample_id long, gap long, type string, prob double"),
        spark.createDataFrame([("h", 0.5), ("s", 0.7), ("x", 1.01)], "type string, base double"),
    )


@pytest.mark.parametrize("policy", ["miss", "exclude"])
def test_each_point_of_a_grid_is_a_judgement_of_its_own(spark, corpus, policy):
    gold, found, limits = corpus
    scales, tolerances = [0.5, 1.0, 1.6], [(0, 0), (2, 1), (4, 4)]
    got = {(r.scale, r.before, r.after, r.type): r for r in E.sweep(gold, found, limits, scales, tolerances, 2, 3, policy).collect()}
    for s in scales:
        for b, a in tolerances:
            fires = E.with_tolerance(E.fired(found, limits, s), b, a)
            own = E.counted(E.judged(gold, fires), policy).collect()
            left = E.spurious(gold, fires).collect()
            for t in (None, "h", "s", "x", "y"):
                r = got[s, b, a, t]
                of = [x for x in own if t in (None, x.type)]
                assert (r.n, r.hits, r.spurious) == (len(of), sum(x.hit for x in of), sum(t in (None, x.type) for x in left))
                assert [r[k] for k in ("wrong_type", "wrong_position", "missing")] == [sum(x.reason == k for x in of) for k in ("wrong_type", "wrong_position", "missing")] and (policy == "exclude" or r.lost == sum(x.reason == "alignment_unreliable" for x in of))
            chance = [got[s, b, a, None].baseline]
            for rep in range(2):
                placed = gold.withColumn("gap", E.stats.drawn(3, F.lit(rep), F.col("sample_id"), F.col("e"), n=F.col("n_words") + 1))
                chance.append(E.judged(placed, fires).where("hit").count() / len(own))
            assert chance[0] == pytest.approx((chance[1] + chance[2]) / 2)
    one = E.baseline(gold, E.fired(found, limits, 1.0), 2, 1, 2, 3).first()
    assert one["reps"] == 2 and (policy == "exclude" or one["mean"] == pytest.approx(got[1.0, 2, 1, None].baseline))
    check = E.tolerance_check(gold, found, limits, 1.0, 2, 1, 2, 3, policy).orderBy("before", "after").collect()
    assert [(r.before, r.after, r.chosen) for r in check] == [(0, 0, False), (2, 1, True), (2, 2, False)] and check[1].hits == got[1.0, 2, 1, None].hits


def test_no_events_or_no_detections(spark, corpus):
    gold, found, limits = corpus
    fires = E.with_tolerance(E.fired(found, limits), 1, 1)
    assert {r.reason for r in E.judged(gold.drop("valid"), fires.limit(0)).collect()} == {"missing"}
    assert E.judged(gold.limit(0), fires).count() == 0 and E.spurious(gold.limit(0), fires).count() == fires.count()
    assert E.sweep(gold.limit(0), found.limit(0), limits, [1.0], [(1, 1)]).count() == 0


def lists(*rows):
    return pa.array([list(map(str, r)) for r in rows], pa.list_(pa.string()))


def test_pieces_give_the_path_of_the_whole_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m, kinds = *rng.integers(0, 14, 2).tolist(), int(rng.integers(1, 5))
        ref, hyp = [lists(*(rng.integers(0, kinds, k) for k in (size, size // 2, 0, size))) for size in (n, m)]
        whole, cut = align.walked(ref, hyp, 10**7), align.walked(ref, hyp, int(rng.integers(4, 40)))
        steps = [[x[o].tolist() for x in (p, i, j)] for p, i, j, _, _, o in (whole, cut)]
        assert steps[0] == steps[1]


def test_two_long_texts_in_little_memory():
    rng = np.random.default_rng(3)
    ref = [f"w{x}" for x in rng.integers(0, 3000, 20_000)]
    hyp = [w if rng.random() > 0.1 else "q" for w in ref if rng.random() > 0.05]
    sides = lists(ref), lists(hyp)
    tracemalloc.start()
    pair, i, j, _, _, order = align.walked(*sides)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000 and len(pair) >= 20_000
    i, j = i[order][::-1], j[order][::-1]
    assert i[i >= 0].tolist() == list(range(len(ref))) and j[j >= 0].tolist() == list(range(len(hyp)))


def test_intervals_of_a_summary(spark):
    parts = spark.createDataFrame([(i, f"p{i % 4}", i % 3, 4 if i % 5 else None, i % 2, 10, 3.0 if i % 2 else float("nan"), 0.5) for i in range(40)], "sample_id long, speaker string, hits int, events int, errors int, ref_words int, pmos double, cosine double")
    got = {r.metric: r for r in report.intervals(parts, 50, 1).collect()}
    assert {k: r.n for k, r in got.items()} == {"nvpa": 32, "wer": 40, "pmos": 20, "ss": 40} and {r.clusters for k, r in got.items()} == {4, 2}
    one = report.components(parts).first()
    assert got["wer"].value == pytest.approx(one.wer) and got["pmos"].value == pytest.approx(one.pmos) and got["ss"].ci_low == got["ss"].ci_high == pytest.approx(0.5)
    assert all(r.ci_low <= r.value <= r.ci_high for r in got.values())
