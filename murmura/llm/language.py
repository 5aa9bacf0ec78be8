"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans of mixed-language text.

Training counts, per language, hashed character n-grams of words (with their edges) and letters per script; the counts are
summed per worker batch and then with map-side combine, so the table has at most BUCKETS + scripts rows a language and no text
moves. It is the model, and is broadcast: its size is languages times BUCKETS, checked against MAX_LANGUAGES.

A word's scores are the logarithms of its n-grams' smoothed probabilities, summed and clipped. A language is a candidate
for a word if the word's main script makes up at least SCRIPT_SHARE of the letters the language was seen with; others are
out (unless no language is a candidate). A text's words then go through Viterbi with a penalty for each change of language.
Most texts are of one language, which can be proved without the tables: a path that uses the best language somewhere has a
change for each stretch of another one, so it loses if no stretch gains the penalty; one that never does has a change less
than stretches, so its first and last stretch together must not gain the penalty either. Only the other texts go through all steps.

lang_pred is the language with most letters among the spans; score is their share. The text is all that a prediction sees.

Defined results: null, empty and letterless texts get und and 0.0; rows without a language don't train; without any
training row everything is und; ties go to the language that is first by code point. Repeated rows train as often as they occur and
are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
PENALTY = 20.0
CLIP = 12.0
SCRIPT_SHARE = 0.001
MAX_LANGUAGES = 400
MEMO = 200_000
UND = "und"
#: First code points of the script ranges that are told apart, and the script's number; 0 is no letter's script of its own.
SCRIPTS = (
    (0x0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xA00, 9), (0xA80, 10), (0xB00, 11), (0xB80, 12),
    (0xC00, 13), (0xC80, 14), (0xD00, 15), (0xD80, 16), (0xE00, 17), (0xE80, 18), (0xF00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x1400, 0),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 24), (0x30A0, 25), (0x3100, 26), (0x3130, 22), (0x3190, 0), (0x3400, 26), (0xA000, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 26), (0xFB00, 0),
)
N_SCRIPTS = 27
SCRIPT_OF = np.repeat(np.array([k for _, k in SCRIPTS], np.int8), np.diff([s for s, _ in SCRIPTS] + [0x110000]))


OTHER = re.compile(r"[\W\d_]+")


def letters_of(words: list[str]) -> list[str]:
    return [w if w.isalpha() else OTHER.sub("", w) for w in words]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which word each character n-gram is of, and its bucket; words are given as letters and get a blank on either side."""
    points = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owners, buckets = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = (h[: len(points) - n + 1] + points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        whole = owner[: len(h)] == owner[n - 1 :]
        if n in GRAMS:
            owners.append(owner[: len(h)][whole])
            buckets.append((h[whole] >> np.uint64(20)) % np.uint64(BUCKETS))
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of most of each word's letters (the lowest number among equals)."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = np.r_[SCRIPT_OF[points], np.int8(1)]  # one more, for words without a letter at the end
    ends = np.cumsum([len(w) for w in words])
    starts = np.r_[0, ends[:-1]]
    out = np.minimum.reduceat(script, starts).astype(np.int64)
    for i in np.flatnonzero((np.maximum.reduceat(script, starts) != out) & (ends > starts)):
        out[i] = np.bincount(script[starts[i] : ends[i]], minlength=N_SCRIPTS).argmax()
    return out


def counted(docs: DataFrame) -> DataFrame:
    """lang, bucket and n: summed counts of the training rows (lang, text); bucket BUCKETS + k is script k."""

    def run(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update((text or "").lower().split())
                if len(words) > 50 or len(words[lang]) > MEMO:
                    yield from flush(words)
        yield from flush(words)

    def flush(words):
        for lang, own in words.items():
            table = np.zeros(BUCKETS + N_SCRIPTS, np.int64)
            items = [(w, n) for w, n in zip(letters_of(list(own)), own.values(), strict=True) if w]
            for at in range(0, len(items), 50_000):
                part, times = [w for w, _ in items[at : at + 50_000]], np.array([n for _, n in items[at : at + 50_000]])
                owner, bucket = grams_of(part)
                table[:BUCKETS] += np.bincount(bucket, times[owner], BUCKETS).astype(np.int64)
                table[BUCKETS:] += np.bincount(scripts_of(part), times * [len(w) for w in part], N_SCRIPTS).astype(np.int64)
            there = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int64()), pa.array(table[there])], names=["lang", "bucket", "n"])
        words.clear()

    return docs.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their n-gram scores (BUCKETS x languages) and which scripts each is written in."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs = langs
        grams = table[:, :BUCKETS].astype(np.float64)
        self.scores = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32).copy() if langs else np.zeros((BUCKETS, 0), np.float32)
        scripts = table[:, BUCKETS:].astype(np.float64)
        self.writes = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
        self.forget()

    def forget(self):
        self.memo: dict[str, int] = {}
        self.table, self.sizes = np.zeros((1024, len(self.langs))), np.zeros(1024, np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "table", "sizes")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.forget()

    def learn(self, words: list[str]) -> None:
        """Puts the scores of new words into the memo."""
        letters = letters_of(words)
        owner, bucket = grams_of(letters)
        size = np.array([len(w) for w in letters], np.int64)
        score = np.stack([np.bincount(owner, self.scores[bucket, k], len(words)) for k in range(len(self.langs))], 1)
        possible = self.writes[:, scripts_of(letters)].T
        possible |= ~possible.any(1, keepdims=True)
        score -= np.where(possible, score, -np.inf).max(1, keepdims=True)
        score = np.where(possible, np.maximum(score, -CLIP), -2 * CLIP)
        score[size == 0] = 0
        at = len(self.memo)
        while at + len(words) > len(self.table):
            self.table, self.sizes = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.table[at : at + len(words)], self.sizes[at : at + len(words)] = score, size
        self.memo.update(zip(words, range(at, at + len(words)), strict=True))

    def look(self, texts: list[list[str]]):
        """Scores and letters of the words of all texts, one after another."""
        if len(self.memo) > MEMO:
            self.forget()
        memo = self.memo
        fresh = list(dict.fromkeys(w for words in texts for w in words if w not in memo))
        for at in range(0, len(fresh), 50_000):
            self.learn(fresh[at : at + 50_000])
        get = memo.__getitem__
        ids = [k for words in texts for k in map(get, words)]
        return self.table[ids], self.sizes[ids]

    def spans(self, score: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """The language of each word on the best path."""
        n, k = score.shape
        total = score.sum(0)
        best = int(total.argmax())
        gain = np.cumsum(score - score[:, best : best + 1], 0)
        least = np.minimum(np.minimum.accumulate(gain, 0), 0.0)
        rise = gain - np.concatenate([np.zeros((1, k)), least[:-1]])
        ends = gain[:-1].max(initial=0.0) + (gain[-1] - gain[:-1]).max(initial=0.0)
        if rise.max() < penalty and ends < penalty:
            return np.full(n, best)
        values, floors = [score[0].tolist()], []
        for row in score[1:].tolist():
            value = values[-1]
            floor = max(value) - penalty
            floors.append(floor)
            values.append([(v if v >= floor else floor) + r for v, r in zip(value, row, strict=True)])
        path = [max(range(k), key=values[-1].__getitem__)]
        for value, floor in zip(reversed(values[:-1]), reversed(floors), strict=True):
            own = path[-1]
            path.append(own if value[own] >= floor else value.index(max(value)))
        return np.array(path[::-1])

    def label(self, texts: list[str | None]):
        """Per text: prediction, score, and its spans as (language, first word, words)."""
        split = [(t or "").lower().split() for t in texts]
        out, at = [], 0
        if not self.langs:
            return [(UND, 0.0, [])] * len(texts)
        scores, sizes = self.look(split)
        for words in split:
            n = len(words)
            own, letters = scores[at : at + n], sizes[at : at + n]
            at += n
            if not letters.any():
                out.append((UND, 0.0, []))
                continue
            path = self.spans(own)
            share = np.bincount(path, letters, len(self.langs))
            edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            spans = [(self.langs[path[a]], int(a), int(b - a)) for a, b in zip(edges, [*edges[1:], n], strict=True)]
            out.append((self.langs[int(share.argmax())], float(share.max() / share.sum()), spans))
        return out


def fit(docs: DataFrame) -> Model:
    """The model of the rows (lang, text) of docs; rows without a language are left out."""
    table = shared.stored(counted(docs.where("lang IS NOT NULL").select("lang", "text")))
    langs = sorted(r["lang"] for r in table.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(langs), BUCKETS + N_SCRIPTS), np.int64)
    place = {x: i for i, x in enumerate(langs)}
    for batch in table.toArrow().to_batches():  # at most languages x (BUCKETS + scripts) rows
        counts[[place[x] for x in batch.column("lang").to_pylist()], batch.column("bucket").to_numpy()] = batch.column("n").to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs, whose text (and any columns of these names) is replaced by lang_pred, score and spans."""
    keep = shared.others(docs, "text", "lang_pred", "score", "spans")
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"] + ["lang_pred string, score double, spans array<struct<lang: string, start: int, words: int>>"])
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))

    def run(batches):
        own = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = own.label(part.column("text").to_pylist())
                spans = pa.array([[dict(zip(("lang", "start", "words"), s, strict=True)) for s in x[2]] for x in out], kind)
                yield pa.RecordBatch.from_arrays([*shared.columns_of(part, keep), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), spans], names=[*keep, "lang_pred", "score", "spans"])

    return docs.mapInArrow(run, schema)


@query("op2_language")
def op2_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
