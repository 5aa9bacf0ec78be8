"""Each operator on small hostile tables, against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests_llm_helpers import spans_of

from murmura.llm import byte_bpe, embeddings, language, lm_score, mixing, quality, secrets, shared, simhash, suffix, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp string, stratum string"


def hostile(seed=1, n=60):
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages and secrets, with clashing extra columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared_text = sentence(40)
    texts = [None, "", " \n\t ", "x", "a b c", "-" * 500, "ab" * 300, sentence(3000)]
    for i in range(n):
        t = sentence(rng.randrange(1, 120))
        if i % 3 == 0:
            t += "\n" + shared_text + "\n" + sentence(5)
        if i % 5 == 0:
            t += f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" AKIA{"ABCDEFGH01234567"} password: secret=abcdefghijklmnop'
        texts.append(t)
    texts += texts[3:20]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), len(t or ""), "r", "f", "s") for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[12], (None, texts[15], None, None, 0, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hostile(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    got = simhash.group(docs).collect()
    own = {(r[0], fingerprint(r[1])) for r in hostile()}
    assert {(r.doc_id, r.fp % (1 << 64)) for r in got} == own
    fps = sorted({f for _, f in own})
    a, b = np.nonzero(np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)) <= 4)
    root = shared.roots(len(fps), a, b)
    least = collections.defaultdict(list)
    for d, f in own:
        least[root[fps.index(f)]].append(d)
    for r in got:
        assert r.component_id == min(d for d in least[root[fps.index(r.fp % (1 << 64))]] if d is not None)
    assert simhash.group(empty).count() == 0


def test_simhash_dense_cells(spark):
    """One large group of near copies, and cells that are cut into blocks."""
    rng, base = random.Random(2), 0x123456789ABCDEF0
    fps = {base}
    while len(fps) < 300:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    own = sorted(fps)
    frame = spark.createDataFrame([(simhash.signed(f),) for f in own], "fp long")
    edges = simhash.links(frame, cell=40).collect()
    place = {f: i for i, f in enumerate(own)}
    a, b = np.nonzero(np.bitwise_count(np.array(own, np.uint64)[:, None] ^ np.array(own, np.uint64)) <= 4)
    got = shared.roots(len(own), np.array([place[e.a % (1 << 64)] for e in edges]), np.array([place[e.b % (1 << 64)] for e in edges]))
    assert (got == shared.roots(len(own), a, b)).all()
    assert len(edges) < 40 * len(own)


def test_simhash_stage(docs, spark):
    kept = simhash.stage(spark, docs, "")
    groups = simhash.group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in groups.collect()})


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(50)] + [(1000, 1100 + i) for i in range(60)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: i for i, x in enumerate(nodes)}
    real = [(at[a], at[b]) for a, b in edges if a != b]
    root = shared.roots(len(nodes), *(np.array(c) for c in zip(*real, strict=True)))
    assert got == {x: nodes[root[at[x]]] for x in nodes}


def test_language(spark, empty):
    words = {"en": "the of and house water stone", "de": "und der haus wässer größe stein", "ru": "дом вода камень и или"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(rng.randrange(5, 40))), x) for i, x in enumerate(rng.choices(list(words), k=150))]
    train = spark.createDataFrame([*rows, (999, "nothing", None), (998, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(train)
    mixed = " ".join(["the house of stone"] * 8 + ["und der stein größe"] * 8 + ["дом и камень"] * 3)
    out = language.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 %%"), (4, "the water"), (5, mixed), (6, "камень")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "de", "ru"]  # of the mixed text, German has most letters
    assert [s.lang for s in out[4].spans] == ["en", "de", "ru"] and sum(s.words for s in out[4].spans) == len(mixed.split())
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in language.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), language.fit(empty)).collect()} == {"und"}


def test_viterbi_shortcut_is_optimal():
    rng = np.random.default_rng(6)
    model = language.Model(["a", "b", "c"], np.ones((3, language.BUCKETS + language.N_SCRIPTS), np.int64))
    for _ in range(200):
        score = -rng.exponential(2.0, (rng.integers(1, 30), 3))
        best = score[0].copy()
        for row in score[1:]:
            best = np.maximum(best, best.max() - 5.0) + row
        path = model.spans(score, 5.0)
        got = score[np.arange(len(path)), path].sum() - 5.0 * (path[1:] != path[:-1]).sum()
        assert abs(got - best.max()) < 1e-9


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert sorted(r.size for r in rows) == sorted(size(r[1]) for r in hostile())
    total = sum(r.size for r in rows)
    target = {r.source: r.target for r in rows}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert all(r.copies <= 2 and r.target <= 2 * r.source_size for r in rows)
    assert mixing.mix(empty).count() == 0


def test_secrets(docs, empty, spark):
    got = secrets.scan(docs).collect()
    assert sorted((str(r.doc_id), [tuple(s) for s in r._spans]) for r in got) == sorted((str(r[0]), spans_of(r[1])) for r in hostile())
    assert any(s[1] == 3 for r in hostile() for s in spans_of(r[1]))
    kept = secrets.stage(spark, docs, "")
    assert kept.columns == docs.columns
    for r in kept.where("text LIKE '%token = %'").collect():
        assert hashlib.sha1(b"0").hexdigest() not in r.text and r.n_chars == len(r.text)
    assert secrets.scan(empty).count() == 0


def test_token_counts(docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    known = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), len(known.encode(r[1] or ""))) for r in hostile())


def test_byte_bpe(docs):
    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), path, pattern), path, pattern).collect()
    assert sorted((str(r.doc_id), r.token_ids, bytes(r.decoded)) for r in got) == sorted((str(r[0]), known.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in hostile())


def test_byte_bpe_cuts_at_spaces():
    """White space of all kinds, contractions, digits and long runs, where a text is cut into words and where not; slices decode alike."""
    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own, rng = byte_bpe.codec(path, pattern), random.Random(9)
    texts = ["".join(rng.choice([" ", " ", "a", "b'", "'s", "\n", "\t", "é", "1", "!", "\u00a0", "\u3000", "\r"]) for _ in range(rng.randrange(14))) for _ in range(5000)]
    texts += ["ab" * 10_000, "- " * 300, " " * 999, "<|endoftext|>"]
    ids = own.encode(texts)
    assert ids.to_pylist() == [known.encode_ordinary(t) for t in texts]
    assert own.decode(ids.slice(7, 50)).to_pylist() == [t.encode() for t in texts[7:57]]
    assert all(own.whole.find(key) == own.whole.slots.index(key) for key in list(ranks)[::997]) and own.whole.find(b"no token") == -1


@pytest.mark.parametrize("filter_bytes", [lm_score.FILTER_BYTES, 0])
def test_lm_score(docs, empty, filter_bytes):
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    frame = lambda df: df.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("held_out"), "text")
    counts = collections.Counter()
    for r in hostile():
        if not held(r[0]):
            counts.update([*(r[1] or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in hostile():
        words = [*(r[1] or "").encode().lower().split(), None]
        want.append((str(r[0]), held(r[0]), len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)))
    got = lm_score.score(frame(docs), filter_bytes).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(-20 * r.n_tokens < r.score <= 0 for r in got)
    assert lm_score.score(frame(empty), filter_bytes).count() == 0


def test_filter_levels():
    rng = np.random.default_rng(7)
    grams = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    counts = rng.integers(1, 1000, len(grams)).astype(np.uint64)
    own = lm_score.Filter({0: lm_score.block_of(grams, counts)}, 1)
    level = np.floor(np.log2(counts.astype(float))) + 1
    assert (own.levels(grams) >= level).all() and (own.levels(grams) == level).mean() > 0.95
    assert (own.levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) == 0).mean() > 0.95


def test_suffix(docs, empty):
    order = sorted({(suffix.NO_ID if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()), (r[1] or "").encode()) for r in hostile()})
    seen, want = set(), {}
    for doc, _, text in order:
        covered = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        kept = bytes(x for x, c in zip(text, covered, strict=True) if not c)
        want[None if doc == suffix.NO_ID else doc] = (len(text), sum(covered), len(re.findall(b"\1+", bytes(covered))), kept)
    got = suffix.dedup(docs).collect()
    assert len(got) == len(hostile())
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert suffix.dedup(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((20, 16))
    near = np.concatenate([base, base + 0.05 * rng.standard_normal((20, 16)), base[:1] + 0.1 * rng.standard_normal((300, 16)), base[:3], rng.standard_normal((300, 16))])
    rows = [(i, x.tolist()) for i, x in enumerate(near)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0, 2.0]), (1005, [])]
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    alike = unit @ unit.T >= 0.95
    np.fill_diagonal(alike, False)
    root = shared.roots(len(near), *np.nonzero(alike))
    want = {i: (int(alike[i].sum()), int(root[i])) for i in range(len(near))} | {k: (0, k) for k in range(1000, 1006)}
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), run=64).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def measured(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    joined = b"".join(words).decode()
    return len(words), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(again)


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 4 and 1, 0) for i in range(40)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.evaluate(docs, labels).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((str(r[0]), *measured(r[1])) for r in hostile())
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality.evaluate(empty, labels).count() == 0


def test_binomial_cdf():
    for n in (1, 7, 60, 400):
        for p in (0.002, 0.05, 0.4, 0.9):
            terms = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
            for x in {0, 1, n // 20, n // 2, n - 1, n}:
                assert quality.binomial_cdf(x, n, p) == pytest.approx(sum(terms[: x + 1]), rel=1e-9, abs=1e-12)
    assert quality.binomial_cdf(10**7, 10**9, 0.01) == pytest.approx(0.5, abs=1e-3)


def test_certified_is_exact():
    assert quality.binomial_cdf(2, 10, 0.3) == pytest.approx(sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3)))
    assert quality.certified([0, 0, 500], [50, 10, 5], 0.05, 0.01) == 2
    assert quality.certified([30, 0, 70], [50, 10, 5], 0.05, 0.01) is None
    assert quality.certified([0, 0, 3], [50, 10, 5], 0.05, 0.01) is None


def test_pipeline(spark):
    import corpus_pipeline
    from murmura.llm.registry import read

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    docs = read(spark, sf, "documents")
    kept = {r.doc_id for r in quality.evaluate(docs, read(spark, sf, "labels")).where("kept").collect()}
    grouped = simhash.group(docs.where(F.col("doc_id").isin(list(kept)))).collect()
    single = {r.doc_id for r in grouped if r.doc_id == r.component_id}
    rest = mixing.mix(secrets.stage(spark, docs.where(F.col("doc_id").isin(list(single))), sf)).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter({r.doc_id: r.copies for r in rest if r.copies})
    assert all(r.n_tokens == len(r.token_ids) for r in out)
