"""Hot cells of fingerprints and words of any length, against brute force and the library."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from murmura.llm import shared, simhash, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def components(own):
    a, b = [], []
    for at in range(0, len(own), 500):
        x, y = np.nonzero(np.bitwise_count(own[at : at + 500, None] ^ own[None, :]) <= simhash.LINK)
        a.append(x + at)
        b.append(y)
    return shared.roots(len(own), np.concatenate(a), np.concatenate(b))


def hot(n, seed):
    """n distinct fingerprints that share their lowest 13 bits, many of them near another."""
    rng = np.random.default_rng(seed)
    own = rng.integers(0, 2**51, n, dtype=np.uint64) << np.uint64(13)
    for k in range(0, n - 3, 3):
        own[k + 1] = own[k] ^ np.uint64(sum(1 << int(b) for b in rng.choice(np.arange(13, 64), int(rng.integers(1, 7)), replace=False)))
    return np.unique(own)


def ball(n, seed):
    """n distinct fingerprints within a few bits of one."""
    rng = np.random.default_rng(seed)
    return np.unique([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)) for _ in range(n)]).astype(np.uint64)


@pytest.mark.parametrize("kind,n,cell", [(hot, 6000, 300), (ball, 3000, 300), (hot, 900, 20), (ball, 900, 20)])
def test_links_of_full_cells(spark, kind, n, cell):
    own = kind(n, n)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "fp long"), cell=cell).collect()
    place = {int(x): i for i, x in enumerate(own.view(np.int64))}
    a, b = np.array([place[e.a] for e in edges]), np.array([place[e.b] for e in edges])
    assert (shared.roots(len(own), a, b) == components(own)).all()


def test_rows_of_a_hot_cell_grow_with_its_members(spark, monkeypatch):
    """What the groups receive: a row for each of the five finer cells and of the four other choices at most; as parts these would be 10 and more."""
    rows, by_group = [], shared.by_group

    def counting(df, *more):
        rows.append(df.count())
        return by_group(df, *more)

    monkeypatch.setattr(shared, "by_group", counting)
    per = {}
    for n in (10_000, 20_000, 40_000):
        rows.clear()
        own = hot(n, 1)
        edges = simhash.links(spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "fp long"))
        assert edges.count() > n // 5
        per[n] = sum(rows) / len(own)
    assert max(per.values()) <= 9


def long_words(seed):
    rng = random.Random(seed)
    pools = ["ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "aé日本x", "a", "the"]
    out = ["".join(rng.choice(pools[k % 6]) for _ in range(rng.choice([127, 128, 129, 400, 1500]))) for k in range(90)]
    return out + ["short " * 3 + "x" * k + " tail" for k in range(100, 400, 13)] + ["".join(rng.choice(["token", "ing", "er", "the", "xq", "日本"]) for _ in range(200)) for _ in range(30)] + ["y" * 5000 + "\n" + "▁" * 300 + "  " * 200]


def test_long_words_equal_the_library():
    texts = long_words(9)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.counted(texts, PIECES) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_both_ways_of_merging_agree():
    model = token_counts.merger(PIECES)[0]
    words = [w for t in long_words(10) for w in token_counts.PRETOKEN.findall("▁" + t.replace(" ", "▁"))] + ["", "▁"]
    assert model.count(words).tolist() == model.count_long(words).tolist()


def test_a_word_of_a_megabyte_takes_seconds(spark):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1_000_000))
    began = time.time()
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame([(1, word, "x"), (2, None, "y"), (2, "a", "z")], "doc_id long, text string, n_tokens string"), PIECES).collect() if r.doc_id == 1}
    assert time.time() - began < 30
    assert got[1].n_tokens == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(word)) and got[1].n_bytes == 1_000_000 and got[1].over_limit
