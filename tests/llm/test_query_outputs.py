"""The opN queries themselves and the pipeline, on tables written to a folder: every column against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest


from murmura import llm
from murmura.llm import byte_bpe, language, mixing, quality, secrets, shared, simhash, suffix

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=21, n=260):
    """Two invented languages, copies, near copies, passages, secrets, junk, nulls, one long text, a hot source and repeated ids."""
    rng = random.Random(seed)
    vocabulary = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(150)] for k, letters in (("en", "abcdefgh"), ("fr", "mnopqrsé"))}
    sentence = lambda k, lang: " ".join(rng.choice(vocabulary[lang]) for _ in range(k))
    passage, rows = sentence(40, "en"), []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = sentence(rng.randrange(3, 160), lang)
        if i % 6 == 0:
            text += "\n" + passage + "\n" + sentence(4, lang)
        if i % 7 == 0:
            text += f' api_key: "{hashlib.sha1(str(i).encode()).hexdigest()}" and AKIA{"ABCDEFGH01234567"}'
        if i % 9 == 0:
            text = text + "\n" + "###$$$ " * rng.randrange(1, 30)
        if i % 10 == 0 and i:
            text = rows[i - 1][1]
        if i % 11 == 0 and i:
            text = rows[i - 1][1] + " " + sentence(1, lang)
        rows.append((i, text, lang if i % 13 else None, "hot" if i % 3 else rng.choice(["a", "b", None]), len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, "12 34", None, "a", 5), (n + 3, sentence(20_000, "en"), "en", "b", 1), rows[5], (None, rows[7][1], "en", "a", 9)]
    return rows


ROWS = documents()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ROWS, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 9 != 0 or i % 4 == 0), i % 50 == 0) for i in range(0, 260)]
    spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rng = np.random.default_rng(22)
    base = rng.standard_normal((30, 8))
    vectors = np.concatenate([base, base[:9] + 0.05 * rng.standard_normal((9, 8)), base[:4]])
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(vectors)] + [(500, None, 0), (500, [0.0] * 8, 0), (3, vectors[3].tolist(), 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def run(spark, sf, name):
    return llm.queries()[name](spark, sf).collect()


def held(doc, k, rest):
    return zlib.crc32(str("" if doc is None else doc).encode()) % k == rest


def sha(x):
    return hashlib.sha256(x).hexdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    import xxhash

    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) if shingles else 0


def least_of_group(rows):
    """doc ids and fingerprints -> the smallest id that each row reaches."""
    fps = sorted({f for _, f in rows})
    own = np.array(fps, np.uint64)
    root = shared.roots(len(fps), *np.nonzero(np.bitwise_count(own[:, None] ^ own) <= 4))
    least = collections.defaultdict(list)
    for d, f in rows:
        least[root[fps.index(f)]].append(d)
    return {f: min((d for d in least[root[k]] if d is not None), default=None) for k, f in enumerate(fps)}


def test_op1(spark, sf):
    own = [(r[0], fingerprint(r[1])) for r in ROWS]
    group = least_of_group(own)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in run(spark, sf, "op1_simhash")) == sorted((str(d), f"{f:016x}", group[f]) for d, f in own)


def test_op2(spark, sf):
    rows = run(spark, sf, "op2_language")
    texts = {r[0]: r for r in ROWS}
    assert len(rows) == len(ROWS)
    right = known = 0
    for r in rows:
        _, text, lang, _, _ = texts[r.doc_id]
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.held_out and lang and r.lang_pred != "und":
            known, right = known + 1, right + (r.lang_pred == lang)
    assert known > 20 and right > 0.9 * known


def test_op4(spark, sf):
    from tests_llm_helpers import spans_of

    want = []
    for r in ROWS:
        spans = spans_of(r[1])
        text = lambda own: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in own)
        count = collections.Counter(k for _, k, _ in spans)
        want.append((str(r[0]), count[0], count[1], count[2], sha(text([s for s in spans if s[1] < 3]).encode()), text(spans)))
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in run(spark, sf, "op4_secrets")) == sorted(want)


def test_op5(spark, sf):
    import public_tokenizers
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = {r[0]: len(known.encode(r[1] or "")) for r in ROWS}
    got = run(spark, sf, "op5_token_counts")
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()), n[r[0]], n[r[0]] > 4096) for r in ROWS)
    assert any(r.over_limit for r in got)


def encoder():
    import base64

    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_op6(spark, sf):
    known = encoder()
    ids = {r[0]: known.encode_ordinary(r[1] or "") for r in ROWS}
    want = [(str(r[0]), len(ids[r[0]]), sha(",".join(map(str, ids[r[0]])).encode()), sha((r[1] or "").encode())) for r in ROWS]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, sf, "op6_byte_bpe")) == sorted(want)


def test_op7(spark, sf):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = collections.Counter(w for r in ROWS if not held(r[0], 7, 2) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)
    want = [(str(r[0]), held(r[0], 7, 2), len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), n, base(r[1])) for r in ROWS]
    got = run(spark, sf, "op7_lm_score")
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(r.score <= 0 for r in got)


def test_op8(spark, sf):
    order = sorted({(suffix.NO_ID if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()), (r[1] or "").encode()) for r in ROWS})
    seen, want = set(), {}
    for doc, _, text in order:
        covered = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        want[str(None if doc == suffix.NO_ID else doc)] = (len(text), sum(covered), len(re.findall(b"\1+", bytes(covered))), sha(bytes(x for x, c in zip(text, covered, strict=True) if not c)))
    got = run(spark, sf, "op8_suffix")
    assert len(got) == len(ROWS) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[str(r.doc_id)] for r in got)


def test_op9(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    usable = [(i, np.array(e, np.float64)) for i, e in rows if e is not None and any(e)]
    unit = np.array([e / np.linalg.norm(e) for _, e in usable])
    alike = unit @ unit.T >= 0.95
    np.fill_diagonal(alike, False)
    root = shared.roots(len(usable), *np.nonzero(alike))
    least = {k: min(usable[i][0] for i in range(len(usable)) if root[i] == k) for k in set(root.tolist())}
    want = [(usable[i][0], int(alike[i].sum()), least[root[i]], usable[i][0] == least[root[i]]) for i in range(len(usable))] + [(i, 0, i, True) for i, e in rows if e is None or not any(e)]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in run(spark, sf, "op9_embeddings")) == sorted(want)


def judged_by_hand(rows, labels):
    """doc_id -> kept, from histograms, exact binomial sums and the rules' own constants."""
    facts = {}
    for d, text, lang, _, _ in rows:
        words = words_of(text)
        solid = "".join(words)
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        share = lambda a, b: a / b if b else 0.0
        values = {
            "symbol_ratio": share(sum(c in "#*$%&|<>" for c in solid), len(solid)), "upper_ratio": share(len(re.findall("[A-Z]", solid)), len(solid)), "dup_line_ratio": share(len(lines) - len(set(lines)), len(lines)),
            "repeat_ratio": share(len(again), len(words)), "long_words": share(len(solid), len(words)), "short_words": share(len(solid), len(words)),
        }
        steps = {k: min(quality.RULES[k][0] - 1, math.floor(v / quality.RULES[k][1])) for k, v in values.items()}
        facts.setdefault(d, []).append((lang, steps, len(words) < 50 or 100 * len(again) > 50 * len(words)))
    strata = sorted({lang for v in facts.values() for lang, _, bad in v if not bad and True}, key=str)
    cuts = {}
    seen = [(lang, steps, labels[d]) for d, v in facts.items() if d in labels for lang, steps, bad in v if not bad]
    tests = max(1, len({lang for lang, _, _ in seen})) * len(quality.RULES)
    for lang in strata:
        for rule, (n, _, high) in quality.RULES.items():
            steps = [(n - 1 - s[rule] if high else s[rule], good) for x, s, good in seen if x == lang]
            good, bad = (sum(g == k for _, g in steps) for k in (1, 0))
            best, chosen = 0.0, None
            for k in range(n):
                x, y = (sum(s <= k and g == w for s, g in steps) for w in (1, 0))
                p = quality.ALPHA / len(quality.RULES)
                if not good or sum(math.comb(good, i) * p**i * (1 - p) ** (good - i) for i in range(x + 1)) > quality.DELTA / tests:
                    break
                gain = y / max(1, bad) - quality.GOOD_WEIGHT * x / good
                if gain > best:
                    best, chosen = gain, k
            cuts[lang, rule] = chosen
    out = {}
    for d, v in facts.items():
        for lang, steps, bad in v:
            hit = any((quality.RULES[r][0] - 1 - s if quality.RULES[r][2] else s) <= cuts[lang, r] for r, s in steps.items() if cuts.get((lang, r)) is not None)
            out[d] = not bad and not hit
    return out


def test_op10(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = judged_by_hand(ROWS, labels)
    got = run(spark, sf, "op10_quality")
    assert len(got) == len(ROWS) and {r.doc_id: r.kept for r in got} == want
    assert 20 < sum(want.values()) < len(want) - 20


def test_pipeline_by_hand(spark, sf, nothing):
    """Every stage again in plain Python, but for the mix's hash, which decides between two numbers of copies."""
    import corpus_pipeline
    from tests_llm_helpers import spans_of

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = judged_by_hand(ROWS, labels)
    left = [r for r in ROWS if kept[r[0]]]
    group = least_of_group([(r[0], fingerprint(r[1])) for r in left])
    single = {r[0]: r for r in left if r[0] == group[fingerprint(r[1])]}
    texts, size = {}, collections.Counter()
    for d, (_, text, _, source, _) in single.items():
        out, at = "", 0
        for a, _, b in spans_of(text):
            if out and a < at:
                at = max(at, b)
            else:
                out, at = out + text[at:a] + secrets.MARK, b
        texts[d] = out + text[at:]
        size[source] += len(words_of(texts[d]))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    budget, free, target = 1.5 * sum(size.values()), set(size), {}
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        free -= full
    rows = corpus_pipeline.run(spark, sf).collect()
    count = collections.Counter(r.doc_id for r in rows)
    known = encoder()
    assert set(count) <= set(single)
    for r in rows:
        assert r.token_ids == known.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)
    for d, (_, _, _, source, _) in single.items():
        rate = target[source] / size[source]
        assert count[d] in {math.floor(rate), math.floor(rate) + 1, round(rate)}
    assert corpus_pipeline.run(spark, nothing).count() == 0


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, nothing, name):
    assert run(spark, nothing, name) == []


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "one two", "x", "y", "z", [5], b"q", 7)], "doc_id long, text string, lang_pred string, score string, spans string, token_ids array<int>, decoded binary, n_words long")
    model = language.fit(spark.createDataFrame([("one two", "en")], "text string, lang string"))
    assert language.identify(rows, model).first().lang_pred == "en"
    both = byte_bpe.decode(byte_bpe.encode(rows, *byte_bpe.vocabulary()), *byte_bpe.vocabulary()).first()
    assert bytes(both.decoded) == b"one two" and both.n_words == 7
    assert quality.with_counts(rows).first().n_words == 2


def test_op8_more_ranges_and_chunks(spark, monkeypatch):
    """Many ranges dealt in several steps, and more borders than a chunk holds."""
    monkeypatch.setattr(suffix, "RANGE", 2_000)
    rng = random.Random(23)
    words = ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(150)]
    plain = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string"), fan=4).collect()}
    seen, want = set(), {}
    for d, t in rows:
        text, covered = t.encode(), bytearray(len(t))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        want[d] = (sum(covered), bytes(x for x, c in zip(text, covered, strict=True) if not c))
    assert plain == want


def test_op1_many_strangers(spark):
    """Cells of strangers as large as they get before blocks grow: the pivots' filter loses no link."""
    rng = np.random.default_rng(24)
    own = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000).astype(np.uint64))
    near = own[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    every = np.unique(np.r_[own, near])
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")).collect()
    place = {int(x): i for i, x in enumerate(every.view(np.int64))}
    got = shared.roots(len(every), np.array([place[e.a] for e in edges]), np.array([place[e.b] for e in edges]))
    assert (got == shared.roots(len(every), *np.nonzero(np.bitwise_count(every[:, None] ^ every) <= simhash.LINK))).all()
    assert [simhash.blocks_for(n) for n in (10, 10**6, 10**8, 10**10, 10**13)] == [5, 5, 6, 7, 9]
