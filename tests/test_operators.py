"""Operators on random cases, against what their definitions say, worked out without them."""

import math
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from murmura.functions import scoring
from murmura.functions import text as T
from murmura.functions import vectors as V
from murmura.operators import align, events, nvpa, stats, timing


def best_path(ref, hyp):
    """The least edit path whose last steps, read from the end, come first in the order match or substitution, deletion, insertion."""

    @lru_cache(None)
    def cost(i, j):
        if not i or not j:
            return i + j
        return min(cost(i - 1, j - 1) + (ref[i - 1] != hyp[j - 1]), cost(i - 1, j) + 1, cost(i, j - 1) + 1)

    @lru_cache(None)
    def path(i, j):
        steps = [(i - 1, j - 1, i and j and (ref[i - 1] != hyp[j - 1])), (i - 1, j, 1), (i, j - 1, 1)]
        for a, b, own in steps:
            if a >= 0 and b >= 0 and cost(a, b) + own == cost(i, j):
                return (*path(a, b), (a if a < i else None, b if b < j else None))
        return ()

    return list(path(len(ref), len(hyp)))


def random_pairs(seed, n, longest):
    rng = random.Random(seed)
    return [tuple([rng.choice("uvwxyz") for _ in range(rng.randrange(longest))] for _ in range(2)) for _ in range(n)]


def test_alignment(spark):
    cases = [*random_pairs(1, 150, 9), *random_pairs(2, 5, 60), ([], []), (["u"], []), ([], ["u"])]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)] + [(-1, None, ["u"])], "n int, ref array<string>, hyp array<string>")
    got = rows.select("n", align.aligned("ref", "hyp").alias("p"), align.edit_counts("ref", "hyp").alias("c")).collect()
    for r in got:
        ref, hyp = cases[r.n] if r.n >= 0 else ([], ["u"])
        want = best_path(tuple(ref), tuple(hyp))
        assert [tuple(x) for x in r.p] == want
        both = [(i, j) for i, j in want if i is not None and j is not None]
        assert tuple(r.c) == (sum(ref[i] != hyp[j] for i, j in both), len(ref) - len(both), len(hyp) - len(both))


def test_alignment_in_small_tables(monkeypatch):
    monkeypatch.setattr(align, "CELLS", 50)
    import pandas as pd

    cases = random_pairs(3, 60, 12)
    got = align.edit_counts.func(pd.Series([a for a, _ in cases]), pd.Series([b for _, b in cases]))
    for (a, b), total in zip(cases, got.sum(axis=1), strict=True):
        assert total == sum(i is None or j is None or a[i] != b[j] for i, j in best_path(tuple(a), tuple(b)))


def test_error_rates_lose_no_row(spark):
    said = spark.createDataFrame([(1, "a", "Uno, DOS tres"), (2, "a", "uno"), (3, "b", "--"), (4, "b", "cuatro"), (5, None, "café")], "id long, speaker string, text string")
    heard = spark.createDataFrame([(1, "uno 2 tres", None), (2, None, "broken"), (3, "x y", None), (5, "café", None)], "id long, text string, error string")
    got = {r.id: r for r in align.rated(said, heard, ["id"]).collect()}
    assert [got[i].error for i in range(1, 6)] == [None, "broken", None, "missing_asr_record", None]
    assert (got[1].sub, got[1].errors, got[1].ref_words, got[1].hyp_has_digits) == (1, 1, 3, True)
    assert (got[3].wer, got[3].ins, got[3].errors) == (None, 2, 2)
    assert got[2].errors is None and got[5].errors == 0
    one = align.summarised(align.rated(said, heard, ["id"])).first()
    assert (one.corpus, one.n_samples, one.n_failed, one.n_hyp_with_digits) == (3 / 4, 5, 2, 1)


def pieces_of(text):
    """Tokens found by a scan for brackets and blanks."""
    out, word, i = [], "", 0
    while i < len(text):
        end = text.find("]", i) if text[i] == "[" else -1
        if end > 0 and "[" not in text[i + 1 : end]:
            out, word, i = [*out, *([word] if word else []), text[i : end + 1]], "", end + 1
        else:
            if text[i] in " \t[]":
                out, word = [*out, *([word] if word else [])], ""
            else:
                word += text[i]
            i += 1
    return [*out, *([word] if word else [])]


def test_tagged_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["q", "r", " ", "  ", "[Hum]", "[sigh]", "[ HUM ]", "[]", "\t", "[", "]"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    ways = [T.parsed(F.col("t"), ["hum"], p).alias(p) for p in ("keep", "drop", "error")]
    for r in df.select("n", *ways).collect():
        tokens = pieces_of(texts[r.n])
        torn = any(c in "[]" for c in re.sub(r"\[[^\[\]]*\]", "", texts[r.n]))
        tags = [(sum(x[0] != "[" for x in tokens[:k]), x[1:-1].strip().lower()) for k, x in enumerate(tokens) if x[0] == "["]
        strange = [x for _, x in tags if x != "hum"]
        assert r.keep.unknown == strange
        for own, kept, bad in ((r.keep, tags, torn), (r.drop, [x for x in tags if x[1] == "hum"], torn), (r.error, tags, torn or strange)):
            if bad:
                assert own.error and own.words is None and own.events is None
            else:
                assert own.error is None and own.words == [x for x in tokens if x[0] != "["]
                assert [(x.gap, x.type, x.e) for x in own.events] == [(g, x, e) for e, (g, x) in enumerate(kept)]
    with pytest.raises(ValueError, match="policy"):
        T.parsed(F.col("t"), ["hum"], "other")


def test_rendering_parses_back(spark):
    df = spark.createDataFrame([(" q [Hum][sigh] r  [hum]",), ("[hum]",), ("q",), ("",)], "t string")
    own = df.select(T.parsed(F.col("t")).alias("p")).select(T.rendered(F.col("p.words"), F.col("p.events"))).collect()
    assert [r[0] for r in own] == ["q [hum] [sigh] r [hum]", "[hum]", "q", ""]


def taken_by_definition(gold, found, before, after):
    """Takes the best pair that is still free, again and again."""
    free = [(abs(d - g), -p, e, d) for e, (t, g) in enumerate(gold) for (u, d), p in found.items() if t == u and -before <= d - g <= after]
    out = {}
    while free:
        best = min(free)
        out[best[2]] = best[3]
        kind = gold[best[2]][0]
        free = [x for x in free if x[2] != best[2] and not (gold[x[2]][0] == kind and x[3] == best[3])]
    return out


def why(kind, gap, found, before, after, valid=True):
    inside = {u for u, d in found if -before <= d - gap <= after}
    if not valid and not inside - {kind}:
        return "alignment_unreliable"
    if inside - {kind}:
        return "wrong_type"
    return "wrong_position" if any(u == kind and not -before <= d - gap <= after for u, d in found) else "missing"


@pytest.mark.parametrize(("before", "after"), [(1, 1), (0, 1), (3, 0), (2, 2)])
def test_matching(spark, before, after):
    rng = random.Random(5)
    g_rows, d_rows, want, left = [], [], {}, set()
    for s in range(60):
        gold = [(rng.choice("hs"), rng.randrange(14)) for _ in range(rng.randrange(9))]
        found = {(rng.choice("hs"), rng.randrange(14)): rng.randrange(1, 5) / 5 for _ in range(rng.randrange(9))}
        valid = [rng.random() < 0.8 for _ in gold]
        g_rows += [(s, "x", t, g, 14, e, valid[e]) for e, (t, g) in enumerate(gold)]
        d_rows += [(s, g, t, p) for (t, g), p in found.items()]
        pairs = taken_by_definition(gold, found, before, after)
        for e, (t, g) in enumerate(gold):
            want[s, e] = ("ok", pairs[e] - g, found[t, pairs[e]]) if e in pairs else (why(t, g, found, before, after, valid[e]), None, found.get((t, g)))
        left |= {(s, t, g) for t, g in found if (t, g) not in {(gold[e][0], d) for e, d in pairs.items()}}
    gold = spark.createDataFrame(g_rows, "sample_id long, speaker string, type string, gap long, n_words long, e int, valid boolean")
    found = events.with_tolerance(spark.createDataFrame(d_rows, "sample_id long, gap long, type string, prob double"), before, after)
    assert {(r.sample_id, r.e): (r.reason, r.offset, r.prob) for r in events.judged(gold, found).collect()} == want
    assert {(r.sample_id, r.type, r.gap) for r in events.spurious(gold, found).collect()} == left
    assert events.counted(events.judged(gold, found), "exclude").count() == sum(r != "alignment_unreliable" for r, _, _ in want.values())


def test_sweep_rises_with_tolerance_and_scale(spark):
    rng = random.Random(6)
    gold = spark.createDataFrame([(s, "x", rng.choice("hs"), rng.randrange(20), 20, e) for s in range(20) for e in range(4)], "sample_id long, speaker string, type string, gap long, n_words long, e int")
    found = spark.createDataFrame([(s, g, t, rng.random()) for s in range(20) for t in "hs" for g in rng.sample(range(20), 4)], "sample_id long, gap long, type string, prob double")
    limits = spark.createDataFrame([("h", 0.5), ("s", 1.01)], "type string, base double")
    rows = events.sweep(gold, found, limits, [0.5, 1.0], [(0, 0), (1, 1), (3, 3)], reps=3).collect()
    of = {(r.type, r.scale, r.before): r for r in rows}
    assert all(of["s", s, b].hits == of["s", s, b].spurious == 0 for s in (0.5, 1.0) for b in (0, 1, 3))
    for s in (0.5, 1.0):
        assert of[None, s, 0].hits <= of[None, s, 1].hits <= of[None, s, 3].hits
    for b in (0, 1, 3):
        own = of[None, 0.5, b]
        assert own.hits >= of[None, 1.0, b].hits and own.lift == pytest.approx(own.accuracy - own.baseline) and 0 <= own.baseline <= 1
    again = events.sweep(gold, found, limits, [0.5], [(3, 3)], reps=3).where("type IS NULL").first()
    assert again.baseline == of[None, 0.5, 3].baseline


def test_tolerances():
    assert [events.tolerance(x) for x in ("2", "0:1")] == [(2, 2), (0, 1)]
    assert [events.tolerance_label(*x) for x in ((2, 2), (0, 1))] == ["2", "0:1"]
    with pytest.raises(ValueError, match="tolerance"):
        events.tolerance("1:2:3")


def window_by_definition(gap, n, at, heard, duration, least, most):
    before = max((i for i in at if i < gap), default=None)
    after = min((i for i in at if i >= gap), default=None)
    if before is None and after is None:
        return None
    a = 0.0 if before is None else heard[at[before]][1]
    b = max(a, duration if after is None else heard[at[after]][0])
    if b - a < least:
        b = min(duration, a + least)
        a = max(0.0, b - least) if b - a < least else a
    wide = (gap > 0 and before != gap - 1) or (gap < n and after != gap)
    return (a, b, wide) if b - a <= most else None


def test_gap_windows(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for s in range(80):
        n, m = rng.randrange(7), rng.randrange(6)
        heard, t = [], 0.0
        for _ in range(m):
            t += rng.choice([0.05, 0.3, 1.7])
            heard.append((t, t + rng.choice([0.0, 0.1])))
        duration = t + rng.choice([0.0, 0.5])
        js = sorted(rng.sample(range(m), min(n, m, rng.randrange(4))))
        at = dict(zip(sorted(rng.sample(range(n), len(js))), js, strict=True))
        pairs = [(i, at.get(i)) for i in range(n)] + [(None, j) for j in range(m) if j not in at.values()]
        rows.append((s, n, pairs, [("w", *x) for x in heard], duration))
        want |= {(s, g): window_by_definition(g, n, at, heard, duration, 0.2, 1.5) for g in range(n + 1)}
    df = spark.createDataFrame(rows, "sample_id long, n_ref int, pairs array<struct<i:int,j:int>>, heard array<struct<text:string,start:double,last_start:double>>, duration double")
    got = {(r.sample_id, r.gap): (r.t0, r.t1, r.widened) if r.valid else None for r in timing.gap_windows(df, 0.2, 1.5).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert (got[k] is None) == (w is None) and (w is None or got[k] == pytest.approx(w))


def test_token_words(spark):
    cases = [(["▁Hel", "lo,", " a-b", "▁▁", "z"], [0.0, 0.1, 0.5, 0.9, 1.0]), (["x"], [1.0, 2.0]), ([], []), (None, None), (["no", "start"], [0.0, 0.2])]
    df = spark.createDataFrame(cases, "t array<string>, at array<double>")
    got = [r[0] and [tuple(x) for x in r[0]] for r in df.select(timing.token_words(F.col("t"), F.col("at"))).collect()]
    assert got == [[("hello", 0.0, 0.1), ("a", 0.5, 0.5), ("b", 0.5, 0.5), ("z", 0.9, 1.0)], None, None, None, [("nostart", 0.0, 0.2)]]
    gaps = spark.createDataFrame([(["-", "a-b", "c"],), ([],)], "w array<string>").select(timing.gap_map(F.col("w"))).collect()
    assert [r[0] for r in gaps] == [[0, 0, 2, 3], [0]]


def test_placement_in_speech(spark):
    """Whole chain on random utterances, against the definitions used above."""
    rng = random.Random(8)
    samples, asr, probs, want = [], [], [], {}
    for s in range(40):
        words = [rng.choice("uvwxyz") for _ in range(rng.randrange(1, 8))]
        tags = sorted((rng.randrange(len(words) + 1), rng.choice("hs")) for _ in range(rng.randrange(4)))
        tagged = " ".join(x for g in range(len(words) + 1) for x in [f"[{t}]" for a, t in tags if a == g] + words[g : g + 1])
        heard = [w for w in words if rng.random() < 0.7]
        times = [0.4 * i + (5.0 if i > 3 else 0.0) for i in range(len(heard))]
        state = rng.choice(["ok"] * 7 + ["none", "failed", "untimed"])
        duration = (times[-1] if times else 0.0) + 0.4
        samples.append((s, "x", tagged))
        if state != "none":
            asr.append((s, heard, None if state == "untimed" else times, duration, "broken" if state == "failed" else None))
        own = {(rng.choice("hs"), rng.randrange(len(words) + 1)): rng.random() for _ in range(4)}
        probs += [(s, g, t, p) for (t, g), p in own.items()]
        if state in ("none", "failed"):
            continue
        usable = state == "ok" and heard
        at = {i: j for i, j in best_path(tuple(words), tuple(heard)) if i is not None and j is not None} if usable else {}
        windows = {g: window_by_definition(g, len(words), at, [(t, t) for t in times], duration, 0.2, 3.0) if usable else None for g in range(len(words) + 1)}
        found = {(t, g): p for (t, g), p in own.items() if windows[g] and p >= 0.3}
        pairs = taken_by_definition([(t, g) for g, t in tags], found, 1, 1)
        for e, (g, t) in enumerate(tags):
            middle = lambda x: (windows[x][0] + windows[x][1]) / 2  # noqa: E731, B023
            seconds = middle(pairs[e]) - middle(g) if e in pairs and windows[g] else None
            want[s, e] = ("ok" if e in pairs else why(t, g, found, 1, 1, windows[g] is not None), seconds)
    frames = spark.createDataFrame(samples, "sample_id long, speaker string, tagged string"), spark.createDataFrame(asr, "sample_id long, tokens array<string>, times array<double>, duration double, error string")
    spelled = frames[1].withColumn("tokens", F.transform("tokens", lambda t: F.concat(F.lit("▁"), t)))
    ready = nvpa.prepared(frames[0], spelled)
    assert ready.count() == 40 and {r[0] for r in ready.select("error").distinct().collect()} == {None, "no ASR record", "ASR failed: broken"}
    limits = spark.createDataFrame([("h", 0.3), ("s", 0.3)], "type string, base double")
    judged, left = nvpa.outcomes(ready, spark.createDataFrame(probs, "sample_id long, gap long, type string, prob double"), limits)
    got = {(r.sample_id, r.e): (r.reason, r.sec_offset) for r in judged.collect()}
    assert {k: r for k, (r, _) in got.items()} == {k: r for k, (r, _) in want.items()}
    assert all(got[k][1] == (None if x is None else pytest.approx(x)) for k, (_, x) in want.items())
    assert left.count() >= 0


def test_scores(spark):
    rng = random.Random(9)
    rows = [tuple([rng.random(), 1.5 * rng.random(), rng.uniform(1, 5), rng.uniform(-1, 1), rng.uniform(1, 5), rng.uniform(1, 5)]) for _ in range(30)]
    df = spark.createDataFrame(rows, "n double, w double, p double, s double, sn double, q double")
    for track, weights in scoring.WEIGHTS.items():
        auto = scoring.automatic(track, *map(F.col, "nwps"))
        for r, (n, w, p, s, sn, q) in zip(df.select(auto, scoring.final(track, auto, F.col("sn"), F.col("q"))).collect(), rows, strict=True):
            parts = {"nvpa": n, "wer": max(0, 1 - w), "pmos": (p - 1) / 4, "ss": max(0, s), "sn": (sn - 1) / 4, "q": (q - 1) / 4}
            assert r[1] == pytest.approx(sum(weights[k] * v for k, v in parts.items()))
            assert r[0] == pytest.approx(sum(weights[k] * parts[k] for k in ("nvpa", "wer", "pmos", "ss")))
    assert df.select(scoring.final("A", F.lit(0.5), F.lit(None).cast("double"), F.col("q"))).first()[0] is None


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, b double")
    assert df.agg(stats.correlation(F.col("a"), F.col("b"))).first()[0] is None


def test_unit_of_zero_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), ([math.inf, 1.0],)], "e array<double>")
    assert [r[0] for r in df.select(V.unit(F.col("e"))).collect()] == [None, [0.6, 0.8], None]
