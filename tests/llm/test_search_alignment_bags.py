"""Ranked search, token alignment and the classifier over bags of passages, against brute force, gradients and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from murmura import llm
from murmura.llm import mil_quality, ranked_search, token_alignment

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def folded(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def top_of(docs, items, top=10):
    """Every document scored for every item by the definition."""
    counts = [(d, collections.Counter(folded(t))) for d, t in docs if folded(t)]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(folded(t))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def corpus(seed=5, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    pick = lambda k: " ".join(words[min(299, int(rng.expovariate(0.02)))] for _ in range(k))
    docs = [(i, pick(rng.choice([3, 20, 60, 400]))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(60)] + [docs[3], docs[3], (None, docs[3][1]), (n + 90, None), (n + 91, ""), (n + 92, "... !"), (n + 93, pick(30_000)), (n + 94, "A" * 50_000)]
    items = [(i, pick(rng.choice([1, 5, 40]))) for i in range(30)] + [(100, docs[7][1]), (101, docs[3][1].upper()), (102, None), (103, "?!"), (104, "not there at all"), (None, docs[9][1]), (105, pick(3)), (105, pick(3)), (106, "a" * 50_000)]
    return docs, items


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shares,room", [((1 / 64, 1 / 8), 200_000), ((1 / 300,), 60), ((), 200_000), ((1 / 100, 1 / 20, 1 / 4), 25)])
def test_search_equals_brute_force_whatever_the_tiers_and_blocks(spark, shares, room):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, 1.0, "item") for x in docs], "doc_id long, text string, score double, item string").repartition(5)
    i = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, rank int").repartition(2)
    assert rows_of(ranked_search.search(d, i, shares=shares, room=room)) == top_of(docs, items)


def test_search_falls_through_only_where_the_proof_fails(spark):
    docs = [(i, f"common{' common' * (i % 5)} word{i % 50}") for i in range(500)]
    items = [(1, "common word7"), (2, "word3 word4"), (3, "common")]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    tier = {r["item_id"]: r["tier"] for r in got.collect()}
    assert tier[2] == 0 and rows_of(got) == top_of(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs, items).collect() == []
    assert ranked_search.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []
    assert ranked_search.search(docs.union(spark.createDataFrame([(1, "?")], docs.schema)), items).collect() == []


def test_search_with_many_words_needs_more_than_64_bits_on_the_way():
    n, counts = np.array([10**9, 5]), np.array([3, 1])
    q = ranked_search.impacts(n, counts, np.array([1, 1]), 10**9, 10**15)
    assert q.tolist() == [(10**9 * c) // (1000 * c + 8 * (10 + 90 * x * 10**9 // 10**15)) for x, c in zip(n.tolist(), counts.tolist())]


def spelled(side):
    return token_alignment.tokenizers_of(A, B)[1 if side == "a" else 3].spelled


def groups_by_hand(text):
    """A's and B's ids and the shared ends, from the libraries on the whole text."""
    enc_a, _, enc_b, _ = token_alignment.tokenizers_of(A, B)
    if not text:
        return [], [], []
    a, b = enc_a.encode(" " + text, add_special_tokens=False).ids, enc_b.encode(text)
    if any(b"".join(spelled(s)[i] for i in ids) != (" " + text).encode() for s, ids in (("a", a), ("b", b))):
        return [], [], []
    ends = [np.cumsum([len(spelled(s)[i]) for i in ids]).tolist() for s, ids in (("a", a), ("b", b))]
    cut, at_a, at_b = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        to_a, to_b = ends[0].index(end, at_a) + 1, ends[1].index(end, at_b) + 1
        cut.append((a[at_a:to_a], b[at_b:to_b]))
        at_a, at_b = to_a, to_b
    return a, b, cut


TEXTS = ["", None, "The cat sat.", "héé 日本語テキスト", "sign ▁ of it", "a  b\n\n\tc<|endoftext|> <s> </s>", "x" * 3000, " lead and trail ", "\x00z \x85q \x1c w", "ﬁ①²  ﬃ", "👍🏽" * 20, "\n", " ", "   ", "tab\t tab \n line \n\n end", "don't  we'll they 've", "　 wide", "The cat sat.", "1 2 33 4444 55555"]


def aligned(spark, texts, **more):
    docs = spark.createDataFrame([(None if i == 1 else i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, pairs int").repartition(3)
    return token_alignment.token_links(docs, A, B, **more)


def by_hand(texts):
    cuts = [groups_by_hand(t) for t in texts]
    counts = collections.Counter((x[-1], y[-1]) for _, _, cut in cuts for x, y in cut)
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for i, (a, b, cut) in enumerate(cuts):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in cut)
        links = [counts[x[-1], y[-1]] for x, y in cut]
        top = sum(counts[x[-1], y[-1]] == best[y[-1]] for x, y in cut)
        out.append((None if i == 1 else i // 2, len(a), len(b), len(cut), len(cut), top, sum(links), hashlib.sha256(text.encode()).hexdigest() if cut else ""))
    return sorted(out, key=repr), counts, best


@pytest.mark.parametrize("frequent", [2_000_000, 40, 0])
def test_alignment_equals_both_libraries_on_whole_texts(spark, frequent):
    rng = random.Random(3)
    letters = "ab é\n 'x日.1  "
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + [" ".join(rng.choice(["cat", "dogs", "Épée", "x_y", "<s>"]) for _ in range(5000))]
    got, table = aligned(spark, texts, frequent=frequent)
    want, counts, best = by_hand(texts)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
    assert {(r["a"], r["b"], r["n"], r["best"]) for r in table.collect()} == {(x, y, n, n == best[y]) for (x, y), n in counts.items()}


def test_alignment_of_an_empty_table(spark):
    got, table = token_alignment.token_links(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert got.collect() == [] and table.collect() == []


def test_components_are_the_minimal_groups_of_any_two_cuttings():
    rng = np.random.default_rng(8)
    for _ in range(60):
        total = int(rng.integers(1, 40))
        widths = [np.diff(np.r_[0, np.sort(rng.choice(np.arange(1, total), int(rng.integers(0, total)), replace=False)), total]) if total > 1 else np.array([1]) for _ in range(2)]
        ends = [np.cumsum(w).tolist() for w in widths]
        both = sorted(set(ends[0]) & set(ends[1]))
        got = token_alignment.groups_of(*widths)
        assert [g.tolist() for g in got] == [[next(k for k, b in enumerate(both) if e <= b) for e in own] for own in ends]


def bag_documents(n=900, seed=2):
    """Long documents of plain words; a bad one hides one passage of junk among many good passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(10, 900))]
        good = i % 4 != 0
        if not good:
            at = rng.randrange(len(own))
            own[at:at] = [rng.choice(words) + rng.choice(["###", "$$$", "&&&"]) for _ in range(70)]
        rows.append((i, " ".join(own), int(good)))
    return rows


def test_classifier_finds_one_bad_passage_and_scores_held_out_documents(spark):
    rows = bag_documents()
    docs = spark.createDataFrame([(i, t, 7.0) for i, t, _ in rows] + [(5000, None, 0.0), (5001, "", 0.0), (5002, "x" * 200_000, 0.0), (None, "plain", 0.0), (rows[1][0], rows[1][1], 0.0)], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, None), (None, 1), (99_999, 0)], "doc_id long, quality int")
    model = mil_quality.train(docs, labels)
    got = mil_quality.classify(docs, model).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    truth = {i: q for i, _, q in rows}
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([x > y for x in good for y in bad]) > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.97
    # The passage with the junk weighs most in nearly all bad documents.
    junk = {i: next(k for k, w in enumerate(t.split()) if w[-1] in "#$&") // mil_quality.PASSAGE for i, t, q in rows if not q}
    assert np.mean([r["top_passage"] - junk[r["doc_id"]] in (0, 1) for r in got if r["doc_id"] in junk]) > 0.9
    assert {round(r["score"], 9) for r in got if r["doc_id"] == rows[1][0]} == {next(round(r["score"], 9) for r in got if r["doc_id"] == rows[1][0])}


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    rows = bag_documents(300)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, source string")
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1 - q if flip and held(i) else q) for i, _, q in rows], "doc_id long, quality int")
        scores.append([(r["doc_id"], r["score"]) for r in mil_quality.classify(docs, mil_quality.train(docs, labels)).orderBy("doc_id").collect()])
    assert scores[0] == scores[1]


def test_the_sample_keeps_its_bounds(spark):
    rows = bag_documents(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    bags, marks = mil_quality.sample(docs, labels, 50, 200)
    assert len(bags) == len(marks) <= 50 and sum(map(len, bags)) <= 200
    for some, score in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0)):
        model = mil_quality.train(docs, some)
        assert {r["score"] for r in mil_quality.classify(docs, model).collect()} == {score}
    assert mil_quality.classify(docs.limit(0), model).collect() == []


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(4)
    bags = [rng.random((k, mil_quality.WIDTH)).astype(np.float32) for k in (1, 4, 2)]
    x, start, label = np.concatenate(bags), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    model = mil_quality.Model(0.6)
    model.start(x, 0)
    model.weights = {k: (w + 0.1 * rng.standard_normal(w.shape)).astype(np.float64) for k, w in model.weights.items()}
    loss = lambda: float(np.mean(np.logaddexp(0, (z := model.forward(x, start)[0])) - label * z))
    slope = model.gradient(x, start, label)
    for k, w in model.weights.items():
        for _ in range(5):
            at = tuple(int(rng.integers(0, s)) for s in w.shape)
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - slope[k][at]) < 1e-5, k


def test_encodings_count_what_they_say():
    text = b"Ab cd cd 12!\n" + b"word " * 70
    e = mil_quality.encoded(text)
    assert e.shape == (2, mil_quality.WIDTH) and mil_quality.encoded(b"").shape == (1, mil_quality.WIDTH) and not mil_quality.encoded(b" \n").any()
    words = text.split()
    first, second = words[:64], words[64:]
    assert np.isclose(e[0, 11], len(set(first)) / 64) and np.isclose(e[1, 12], 1.0) and np.isclose(e[0, 13], 1 / 64)
    assert np.isclose(e[1, 8], np.log1p(len(second)) / 4) and np.isclose((e[0, -mil_quality.BUCKETS :] ** 2).sum(), 1, atol=1e-5)


def test_queries_are_registered():
    assert {"op11_ranked_search", "op12_token_alignment", "op13_mil_quality"} <= set(llm.queries()) and "op11_ranked_search" in llm.oracle_sql()
