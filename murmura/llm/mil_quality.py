"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages (PASSAGE words each, the last one shorter). Every passage is encoded: shares of kinds of
characters, word lengths, repetition inside the passage and of earlier words of the document, and the square roots of its
frequencies of hashed byte pairs. The model embeds each encoding (tanh layer), weighs the embeddings by gated attention,
softmax of w . (tanh(V h) * sigmoid(U h)), and scores their weighted mean by a logistic unit. Labels are known of documents
only; the attention weights are learned from them, so that a junk passage can decide a long document.

The model is fitted by Adam on the driver, on a sample of at most DOCUMENTS labelled documents with at most PASSAGES passages
together, in the order of a hash of doc_id; everything else covers all documents: each text is encoded and scored where it is
read, with the weights (some 60 KB) in the task, and nothing of it is shuffled. The fit is seeded and single-threaded
arithmetic, so that reruns agree.

Defined results: null text counts as empty, and an empty text is one passage without words, so it has a score. A null doc_id is
held out as crc32 of the empty string says. Several labels of one document are one, their mean; null labels, labels of unknown
documents and labels of held-out documents teach nothing. With labels of one kind only, or none, every score is the mean label
(0.5 without labels). Rows are scored one by one, so repeated rows agree; an empty table gives no rows; other columns, of
whatever names, are not read. A long text costs memory in proportion to its length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

#: Bounds of the labelled sample that the model is fitted on.
DOCUMENTS, PASSAGES = 6_000, 60_000
#: Words of a passage, buckets of byte pairs, sizes of the embedding and of the attention layer.
PASSAGE, BUCKETS, EMBEDDING, ATTENTION = 64, 96, 32, 16
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.004, 1e-4
THRESHOLD = 0.3
#: Bytes by kind: lower case, upper case, digits, other ASCII signs, sentence signs, line ends, beyond ASCII.
KIND = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 4 if b in b".,;:!?'\"-()" else 5 if b == 10 else 6 if b >= 128 else 7 if b in b" \t\r\x0b\x0c" else 3 for b in range(256)])
KINDS = 8
PLAIN = KINDS + 6
WIDTH = PLAIN + BUCKETS
BLANK = (KIND == 5) | (KIND == 7)


def encoded(text: bytes) -> np.ndarray:
    """The encodings of a text's passages, one row each."""
    raw = np.frombuffer(text, np.uint8)
    solid = ~BLANK[raw]
    begin = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    n = len(begin)
    passages = max(1, -(-n // PASSAGE))
    out = np.zeros((passages, WIDTH), np.float32)
    if not n:
        return out
    # Passage of each byte: from the first byte of its first word on; what comes before the first word is of the first.
    edge = begin[::PASSAGE].copy()
    edge[0] = 0
    owner = np.repeat(np.arange(passages), np.diff(np.r_[edge, len(raw)]))
    size = np.maximum(1, np.bincount(owner, minlength=passages))
    out[:, :KINDS] = np.bincount(owner * KINDS + KIND[raw], minlength=passages * KINDS).reshape(passages, KINDS) / size[:, None]
    words = text.split()
    first: dict[bytes, int] = {}
    number = np.array([first.setdefault(w, i) for i, w in enumerate(words)])  # a word's first place in the document
    length = np.array(list(map(len, words)))
    at = np.arange(n) // PASSAGE
    in_passage = np.bincount(at, minlength=passages)
    own = np.unique(at * n + number)  # distinct words of each passage
    mean = np.bincount(at, length, passages) / in_passage
    out[:, KINDS] = np.log1p(in_passage) / 4
    out[:, KINDS + 1] = np.log1p(mean)
    out[:, KINDS + 2] = np.sqrt(np.maximum(0, np.bincount(at, length * length, passages) / in_passage - mean * mean)) / 8
    out[:, KINDS + 3] = np.bincount(own // n, minlength=passages) / in_passage
    out[:, KINDS + 4] = np.bincount(at, (number < at * PASSAGE), passages) / in_passage
    last = KIND[raw[np.r_[np.flatnonzero(solid & ~np.r_[solid[1:], False])]]]
    out[:, KINDS + 5] = np.bincount(at, last >= 3, passages) / in_passage  # words that end in a sign
    pair = (raw[:-1].astype(np.uint32) * 257 + raw[1:]) * np.uint32(2654435761)
    bucket = (pair >> np.uint32(16)) % BUCKETS
    grams = np.bincount(owner[:-1] * BUCKETS + bucket, minlength=passages * BUCKETS).reshape(passages, BUCKETS)
    out[:, PLAIN:] = np.sqrt(grams / np.maximum(1, grams.sum(axis=1, keepdims=True)))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Weights: scaling of the encodings, embedding E, attention V, U, w, and the scoring unit c."""

    def __init__(self, prior: float):
        self.prior = prior
        self.weights: dict[str, np.ndarray] | None = None

    def start(self, x: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        layer = lambda a, b: (rng.standard_normal((a, b)) / math.sqrt(a)).astype(np.float32)
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 1e-3)
        self.weights = {"E": layer(WIDTH, EMBEDDING), "e": np.zeros(EMBEDDING, np.float32), "V": layer(EMBEDDING, ATTENTION), "U": layer(EMBEDDING, ATTENTION), "w": np.zeros(ATTENTION, np.float32), "c": layer(EMBEDDING, 1)[:, 0]}
        self.weights["b"] = np.array([math.log(self.prior / (1 - self.prior))], np.float32)

    def forward(self, x: np.ndarray, start: np.ndarray):
        """Logit of each bag, and what the gradient needs; bags are runs of rows that begin at start."""
        p = self.weights
        size = np.diff(np.r_[start, len(x)])
        s = np.clip((x - self.mean) * self.scale, -8, 8)
        h = np.tanh(s @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        score = (t * g) @ p["w"]
        score = np.exp(score - np.repeat(np.maximum.reduceat(score, start), size))
        a = score / np.repeat(np.add.reduceat(score, start), size)
        z = np.add.reduceat(h * a[:, None], start)
        return z @ p["c"] + p["b"][0], (s, h, t, g, a, z, size)

    def gradient(self, x: np.ndarray, start: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        logit, (s, h, t, g, a, z, size) = self.forward(x, start)
        d = (sigmoid(logit) - label) / len(label)
        dz = np.repeat(d, size)[:, None] * p["c"]
        da = (dz * h).sum(axis=1)
        dscore = a * (da - np.repeat(np.add.reduceat(a * da, start), size))
        dt, dg = dscore[:, None] * p["w"] * g * (1 - t * t), dscore[:, None] * p["w"] * t * g * (1 - g)
        dh = (dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": s.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ dscore, "c": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> None:
        """Adam over bags in batches, with weights shrunk a little at each step."""
        self.start(np.concatenate(bags), seed)
        rng = np.random.default_rng(seed + 1)
        m, v = ({k: np.zeros_like(w) for k, w in self.weights.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                size = np.array([len(bags[i]) for i in own])
                step += 1
                for k, d in self.gradient(np.concatenate([bags[i] for i in own]), np.cumsum(size) - size, labels[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    change = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - rate * (change + DECAY * self.weights[k])).astype(np.float32)

    def judge(self, bag: np.ndarray) -> tuple[float, int]:
        """Score of one document, and its passage that weighs most. One document at a time, so that equal texts score alike."""
        if self.weights is None:
            return self.prior, 0
        logit, (_, _, _, _, attention, _, _) = self.forward(bag, np.zeros(1, np.int64))
        return float(np.clip(sigmoid(logit[0].astype(np.float64)), 0.0, 1.0)), int(attention.argmax())


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, documents: int, passages: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Encodings and labels of a bounded number of documents, in the order of a hash of doc_id."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("label"))
    # Labels of unknown documents drop out first, so that they take no place in the sample.
    there = one.join(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    few = F.broadcast(there.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(documents))  # at most `documents` rows

    def run(batches):
        for batch in shared.parts(batches):
            bags = [encoded(t) for t in shared.texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([len(b) for b in bags], pa.int32()), pa.array([b.astype(np.float16).tobytes() for b in bags], pa.binary())], names=["doc_id", "label", "n", "bag"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id").select("doc_id", "label", "text")
    bags = shared.stored(chosen.mapInArrow(run, "doc_id long, label double, n int, bag binary").withColumn("place", F.xxhash64("doc_id", F.lit(13))).withColumn("sum", F.crc32("bag")))
    # Rows that repeat a doc_id are rows of the sample too, but no more than its bounds allow.
    sizes = bags.select("place", "doc_id", "sum", "n").orderBy("place", "doc_id", "sum").limit(documents).collect()
    used, most = 0, 0
    for row in sizes:
        if used + row["n"] > passages and most:
            break
        used, most = used + row["n"], most + 1
    rows = bags.orderBy("place", "doc_id", "sum").limit(most).select("label", "bag").collect()
    return [np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows], np.array([r["label"] for r in rows], np.float32)


def train(docs: DataFrame, labels: DataFrame, documents: int = DOCUMENTS, passages: int = PASSAGES) -> Model:
    bags, marks = sample(docs, labels, documents, passages)
    model = Model(float(marks.mean()) if len(marks) else 0.5)
    if len(marks) and 0 < model.prior < 1:
        model.fit(bags, marks)
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and top_passage (the number of the passage that weighs most, from 0) of every row."""

    def run(batches):
        for batch in shared.parts(batches, 200):
            bags = [encoded(t) for t in shared.texts_of(batch.column("text"))]
            score, most = zip(*map(model.judge, bags), strict=True)
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array([len(b) for b in bags], pa.int64()), pa.array(most, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted", "n_passages", "top_passage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long, top_passage long")


@query("op13_mil_quality")
def op13_mil_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, read(spark, sf_dir, "labels")))
