"""Cases where an operator once did less than the whole job."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from murmura.llm import embeddings, language, lm_score, secrets, shared, simhash, suffix


def test_suffix_crowded_grams(spark):
    """A passage of many texts: its ends have another context in each, and no gram's contexts meet in one task."""
    rng = random.Random(11)
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(k))
    passage, half = words(60), words(12)
    rows = [(i, words(rng.randrange(1, 30)) + (half if i % 4 == 0 else " ") + passage + words(rng.randrange(0, 30))) for i in range(200)]
    rows += [(None, rows[3][1]), (None, passage), rows[5], rows[5], (300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted({(suffix.NO_ID if d is None else d, zlib.crc32((t or "").encode()), (t or "").encode()) for d, t in rows})
    seen, want = set(), {}
    for doc, total, text in order:
        covered = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        kept = bytes(x for x, c in zip(text, covered, strict=True) if not c)
        want[None if doc == suffix.NO_ID else doc, len(text)] = (sum(covered), len(re.findall(b"\1+", bytes(covered))), kept)
    for group, crowd, fan in ((suffix.GROUP, suffix.CROWD, suffix.FAN), (20, 16, 3), (1, 1000, 2)):
        got = suffix.dedup(docs, group, crowd, fan).collect()
        assert len(got) == len(rows)
        assert all((r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id, r.n_bytes] for r in got)
    found = suffix.matches(suffix.indexed(docs, 8), 8, 20)
    texts, _ = suffix.repeats(docs)
    parts = suffix.fetched(texts, found.where("gram IS NOT NULL"), 16).collect()
    entries = collections.Counter(r.gram for r in found.where("gram IS NOT NULL").collect())
    assert max(entries.values()) > 100
    assert max(collections.Counter((r.kind, r.gram) for r in parts if r.kind != suffix.KNOWN).values()) < 60


def test_lm_score_is_one_in_both_modes(spark):
    """Unknown and rare words enough for false positives of single words in the filter."""
    rng = random.Random(12)
    rows = [(i, i % 3 == 0, " ".join(f"w{min(rng.randrange(1, 6000), rng.randrange(1, 6000))}" for _ in range(60))) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, False, None)], "doc_id long, held_out boolean, text string")
    for own in (docs, docs.where("held_out")):
        whole, *others = ({r.doc_id: r for r in lm_score.score(own, *x).collect()} for x in ((lm_score.FILTER_BYTES,), (-1,), (-1, lm_score.MU, 2, 3000), (lm_score.FILTER_BYTES, lm_score.MU, 3)))
        assert len(whole) == own.count() and all(whole == x for x in others)


def test_lm_score_by_the_formula(spark):
    """Scores from quantised counts, in plain Python; a few differ, by the filter's false positives."""
    rng = random.Random(17)
    rows = [(i, i % 4 == 0, " ".join(f"w{min(rng.randrange(1, 300), rng.randrange(1, 300))}" for _ in range(rng.randrange(40)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")
    one, two = collections.Counter(), collections.Counter()
    for _, out, text in rows:
        if not out:
            words = ["<s>", *text.split(), "</s>"]
            one.update(words)
            two.update(zip(words, words[1:], strict=False))
    n, v = sum(one.values()) - one["<s>"], len(one) - 1
    level = lambda c: 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c else 0.0
    close = 0
    for r in lm_score.score(docs).collect():
        words, want = ["<s>", *rows[r.doc_id][2].split(), "</s>"], 0.0
        for a, b in zip(words, words[1:], strict=False):
            before = level(one[a])
            want += math.log10((min(level(two[a, b]), before) + lm_score.MU * (level(one[b]) + 1) / (n + v + 1)) / (before + lm_score.MU))
        close += abs(r.score - want) < 1e-9
        assert abs(r.score - want) < 0.1 * abs(want) + 2
    assert close > 80


def test_simhash_stage_keeps_one_row_a_component(spark):
    """Unrelated texts without an id or with one id all stay; of one component, one row does, whatever its ids."""
    rng = random.Random(13)
    text = lambda: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(80))
    a, b, c, *others = (text() for _ in range(12))
    rows = [(None, t) for t in others] + [(1, a), (5, a), (5, b), (7, c), (7, text()), (8, c), (8, c), (None, c), (None, None), (None, ""), (9, others[0]), (9, others[0])]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, sum long")
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = [(None, t) for t in others[1:]] + [(9, others[0]), (1, a), (5, b), (7, c), (7, rows[len(others) + 4][1])]
    assert sorted(t for _, t in got if t) == sorted(t for _, t in want)
    assert {t: d for d, t in got if t} == {t: d for d, t in want}
    assert sum(not t for _, t in got) == 1


def test_viterbi_never_skips_a_better_path():
    """Halves of two languages and a third that is close to both: the best in total is on no word of the best path."""
    rng = np.random.default_rng(14)
    model = language.Model(["a", "b", "c"], np.ones((3, language.BUCKETS + language.N_SCRIPTS), np.int64))
    halves = np.array([[0, -12, -5.5], [0, -12, -5.5], [-12, 0, -5.5], [-12, 0, -5.5]])
    assert model.spans(halves, 20.0).tolist() == [0, 0, 1, 1]
    cases = [(halves, 20.0), (halves[:1], 20.0)]
    for _ in range(2000):
        parts = [np.where(np.arange(3) == rng.integers(3), 0.0, -rng.uniform(0, 12, 3)) * np.ones((rng.integers(1, 12), 1)) for _ in range(rng.integers(1, 5))]
        cases.append((np.concatenate(parts) - rng.exponential(0.5, (sum(map(len, parts)), 3)), float(rng.uniform(2, 40))))
    for score, penalty in cases:
        best = score[0].copy()
        for row in score[1:]:
            best = np.maximum(best, best.max() - penalty) + row
        path = model.spans(score, penalty)
        got = score[np.arange(len(path)), path].sum() - penalty * (path[1:] != path[:-1]).sum()
        assert abs(got - best.max()) < 1e-9


def test_secrets_on_long_paths_and_many_hits(spark):
    """Paths of 100,000 segments, 20,000 hits in one text, long runs of one character; every hit is found, placed and cut out."""
    rng = random.Random(15)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    hits = [f"é{'x' * (i % 5)} " + hashlib.md5(str(i).encode()).hexdigest() for i in range(20_000)]
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    texts = ["ab/" * 100_000, " ".join(hits), "é" * 1_000_000, "A" * 1_000_000, "a-" * 500_000 + key(40), f"path/sample/{key(40)}", f"id={uuid}/{key(40)}", f"id={uuid}/small"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, _spans string")
    rows = {r.doc_id: r for r in secrets.scan(docs).collect()}
    spans = lambda i, k: [tuple(s) for s in rows[i]._spans if s["kind"] == k]
    assert not rows[0]._spans and not rows[2]._spans and not rows[3]._spans and not rows[7]._spans
    at, want = 0, []
    for h in hits:
        want.append((at + len(h) - 32, 2, at + len(h)))
        at += len(h) + 1
    assert spans(1, 2) == want
    assert all(len(spans(i, 3)) == 1 and spans(i, 3)[0][2] > len(texts[i]) - 20 for i in (4, 5, 6))
    kept = {r.doc_id: r.text for r in docs.select("doc_id", secrets.redacted(F.col("text"), secrets.spans_of(F.col("text"))).alias("text")).collect()}
    assert kept[0] == texts[0] and kept[1] == " ".join(h[:-32] + secrets.MARK for h in hits)


def test_redaction_of_overlapping_spans(spark):
    rng, cases = random.Random(16), []
    for i in range(300):
        text = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 80)))
        spans = sorted((a, 0, min(len(text), a + rng.randrange(1, 12))) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(0, 12))))
        cases.append((i, text, spans))
    rows = spark.createDataFrame(cases, "i long, text string, spans array<struct<start:int,kind:int,end:int>>")
    for r in rows.select("i", secrets.redacted(F.col("text"), F.col("spans")).alias("out")).collect():
        _, text, spans = cases[r.i]
        out, at, open_ = "", 0, False
        for a, _, b in spans:
            if open_ and a < at:
                at = max(at, b)
            else:
                out, at, open_ = out + text[at:a] + secrets.MARK, b, True
        assert r.out == out + text[at:]


def test_embedding_counts_of_large_components(spark):
    """A tight group, a chain round the circle and a loose cloud in one table: counts by centres, by radii and by meeting runs."""
    rng = np.random.default_rng(18)
    base, turn = rng.standard_normal((3, 12)), np.linspace(0, 6, 700)
    tight = base[0] + 0.02 * rng.standard_normal((500, 12))
    chain = np.outer(np.cos(turn), [1, *[0] * 11]) + np.outer(np.sin(turn), [0, 1, *[0] * 10])
    cloud = base[1] + 0.35 * np.linalg.norm(base[1]) / np.sqrt(12) * rng.standard_normal((900, 12))
    both = base[2] + np.r_[0.01, 0.3][rng.integers(2, size=500)][:, None] * rng.standard_normal((500, 12))
    all_ = np.concatenate([tight, chain, cloud, both, tight[:5]])
    unit = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    alike = unit @ unit.T >= 0.95
    np.fill_diagonal(alike, False)
    root = shared.roots(len(all_), *np.nonzero(alike))
    rows = spark.createDataFrame([(i, x.tolist(), "c", 1) for i, x in enumerate(all_)], "vec_id long, embedding array<double>, component string, key int")
    for run in (32, 300):
        got = {r.vec_id: r for r in embeddings.near_duplicates(rows.repartition(5), run=run).collect()}
        assert [got[i].n_links for i in range(len(all_))] == alike.sum(1).tolist()
        assert [got[i].component_id for i in range(len(all_))] == root.tolist()
    twice = {r.vec_id: r.n_links for r in embeddings.near_duplicates(rows.where("vec_id < 40").union(rows.where("vec_id < 40")), run=16).collect()}
    assert twice[0] == 2 * int(alike[0, :40].sum()) + 1


def test_embedding_passes_grow():
    known = [embeddings.passes_for(n, 0.95, 512) for n in (0, 10**4, 10**6, 10**9, 10**11)]
    assert known == sorted(known) and known[0] == embeddings.PASSES and known[3] > 30
