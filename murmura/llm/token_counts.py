"""Token counts by rank-synchronous merging over ragged numpy arrays.

A sentencepiece BPE model is read from its file: the pieces give the symbols, and every split of a piece into two symbols
gives a pair that merges into it, ranked by the piece's score. Texts are cut into pre-tokens where no piece can span
(before a run of spaces, and around line ends), the pre-tokens of a batch are laid out as one flat symbol array with
offsets, and in each round every sequence applies its lowest-rank pair at once. Surviving symbols are the tokens; a
character that is no piece counts its UTF-8 bytes (byte fallback).

The library merges one pair at a time, leftmost first. Applying all occurrences of a sequence's lowest pair together is
the same unless one of them makes a pair of no higher rank; such a sequence applies only its leftmost occurrence that round.

Counts of pre-tokens are kept per Python worker in a memo of at most MEMO entries. Nothing is shuffled; the vocabulary is
read on each worker from its (parameter) path, as fixed by the installed package, and has a fixed size.

A pre-token of more than LONG characters (a text without spaces is one, however long) is merged over linked symbols with their
places kept by rank: a round touches the pairs of one rank only, so a word costs time in proportion to its merges.

Defined results: null or empty text has 0 bytes and 0 tokens; strings that look like special tokens are ordinary text. Rows are
counted one by one, so repeated rows and doc_ids stay apart; an empty table gives no rows; other columns, of whatever names, are not read.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from murmura.llm import shared
from murmura.llm.registry import query, read

LIMIT = 4096
MEMO = 400_000
#: Pre-tokens merged in one go have at most so many characters together, unless a single one is longer.
CHUNK = 1_000_000
#: Longer pre-tokens are merged with their places kept by rank, as a round over all their symbols would be repeated too often.
LONG = 128
SPACE = "▁"
PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
NONE = np.iinfo(np.int64).max


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 2:
            n, at = varint(data, at)
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 == 5:
            yield key >> 3, data[at : at + 4]
            at += 4
        elif key & 7 == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        else:
            value, at = varint(data, at)
            yield key >> 3, value


def normal_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file with their scores; unknown, control and byte pieces are left out."""
    with open(path, "rb") as f:
        model = f.read()
    out = []
    for number, piece in fields(model):
        if number == 1:
            own = dict(fields(piece))
            if own.get(3, 1) == 1:
                out.append((own[1].decode(), float(np.frombuffer(own[2], "<f4")[0])))
    return out


class Merger:
    """Symbols, pairs and ranks of one model."""

    def __init__(self, path: str):
        pieces = normal_pieces(path)
        scores = sorted({s for _, s in pieces}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        self.ids = {p: i for i, (p, _) in enumerate(pieces)}
        self.n = len(pieces) + 1  # the last id stands for characters that are no piece
        self.points = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        for p in self.ids:  # what the cuts of PRETOKEN rely on
            assert SPACE not in p.lstrip(SPACE) and (p == "\n" or "\n" not in p), p
        pairs = {}
        for p, s in pieces:
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = (rank[s], self.ids[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.table = np.full(0x110000, self.n - 1, np.int32)
        self.table[list(self.points)] = list(self.points.values())

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is none) and merged symbol of each pair."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def symbols_of(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all pre-tokens, the pre-token of each, and the tokens that characters without a piece add to each pre-token."""
        points = np.frombuffer("".join(pretokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(pretokens)), [len(p) for p in pretokens])
        symbols = self.table[points].astype(np.int64)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        return symbols, owner, np.bincount(owner, np.where(symbols == self.n - 1, width - 1, 0), len(pretokens)).astype(np.int64)

    def count_long(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token, for long ones: places are kept by rank, so that a round touches its own pairs and their neighbours only.

        Symbols are linked to their neighbours within a pre-token. Each round takes the lowest rank that any pair has and applies
        its pairs in all pre-tokens, from the left; in a pre-token where one of them makes a pair of no higher rank, those behind it
        wait for the next round.
        """
        symbols, owner, out = self.symbols_of(pretokens)
        n = len(symbols)
        if not n:
            return out
        right = np.arange(1, n + 1)
        right[np.r_[owner[1:] != owner[:-1], True]] = n
        left = np.full(n + 1, -1)
        left[right[right < n]] = np.flatnonzero(right < n)
        symbols = np.r_[symbols, 0]
        rank = np.full(n + 1, NONE)
        first = np.flatnonzero(right < n)
        rank[first] = self.look(symbols[first], symbols[first + 1])[0]
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            """Puts places where their ranks are found."""
            places = places[rank[places] != NONE]
            own = rank[places]
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
            for r, part in zip(own[edge].tolist() if len(own) else [], np.split(places, edge[1:]) if len(own) else [], strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(part)

        wait(first)
        while queue:
            r = heapq.heappop(queue)
            parts = waiting.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            # Of pairs that overlap, every second one counts, from the left.
            run = np.flatnonzero(np.r_[True, right[at[:-1]] != at[1:]])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            take = at[place % 2 == 0]
            gone = right[take]
            new = self.look(symbols[take], symbols[gone])[1]
            after, before = right[gone], left[take]
            # A pair with the left neighbour, which has just been merged itself where it was taken too.
            joined = np.r_[False, gone[:-1] == before[1:]]
            prior = np.where(joined, np.r_[0, new[:-1]], symbols[before])
            up = np.where(after < n, self.look(new, symbols[after])[0], NONE)
            down = np.where(before >= 0, self.look(prior, new)[0], NONE)
            low = np.minimum(up, down) <= r
            if low.any():
                own = owner[take]
                stop = np.full(len(pretokens), n)
                np.minimum.at(stop, own[low], take[low])
                keep = take <= stop[own]
                take, gone, new, after = take[keep], gone[keep], new[keep], after[keep]
                late = at[at > stop[owner[at]]]
                if len(late):
                    waiting.setdefault(r, []).append(late)
                    heapq.heappush(queue, r)
            symbols[take] = new
            right[take] = after
            inner = after < n
            left[after[inner]] = take[inner]
            rank[gone] = NONE
            out -= np.bincount(owner[take], minlength=len(out))
            # Ranks of the pairs that merged symbols are now in, as left and as right one.
            touched = np.unique(np.concatenate([take, left[take][left[take] >= 0]]))
            there = right[touched] < n
            rank[touched] = NONE
            touched = touched[there]
            rank[touched] = self.look(symbols[touched], symbols[right[touched]])[0]
            wait(touched)
        return out + np.bincount(owner, minlength=len(out))

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        symbols, owner, out = self.symbols_of(pretokens)
        while len(symbols) > 1:
            rank, made = self.look(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NONE
            live = rank != NONE
            # The lowest rank of each sequence, from its first symbol on.
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(np.r_[rank, NONE], starts)
            seq = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(symbols)]))
            done = low == NONE
            hit = np.flatnonzero(live & (rank == low[seq[:-1]]))
            if len(hit):
                # Of occurrences that overlap, every second one counts, from the left.
                run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
                place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
                first = np.r_[True, seq[hit][1:] != seq[hit][:-1]]
                take = place % 2 == 0
                at = hit[take]
                first = first[take]
                own, new = low[seq[at]], made[at]
                # Pairs that the merge makes with its neighbours; a rank that is no higher forbids merging together.
                right = np.minimum(at + 2, len(symbols) - 1)
                after, _ = self.look(new, symbols[right])
                after[(at + 2 >= len(symbols)) | (owner[right] != owner[at])] = NONE
                left = np.maximum(at - 1, 0)
                joined = np.r_[False, at[1:] - at[:-1] == 2]  # the left neighbour has just been merged
                neighbour = np.where(joined, np.r_[0, new[:-1]], symbols[left])
                before, _ = self.look(neighbour, new)
                before[(at == 0) | (owner[left] != owner[at])] = NONE
                hazard = np.zeros(len(starts), bool)
                hazard[seq[at[np.minimum(after, before) <= own]]] = True
                at_take = first | ~hazard[seq[at]]
                at = at[at_take]
                symbols[at] = made[at]
                keep = np.ones(len(symbols), bool)
                keep[at + 1] = False
            else:
                keep = np.ones(len(symbols), bool)
            if done.any():  # finished sequences leave the arrays
                gone = done[seq]
                out += np.bincount(owner[gone & keep], minlength=len(out))
                keep &= ~gone
            symbols, owner = symbols[keep], owner[keep]
        return out + np.bincount(owner, minlength=len(out))


@lru_cache(2)
def merger(path: str) -> tuple[Merger, dict]:
    return Merger(path), {}


def counted(texts: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    model, memo = merger(path)
    if len(memo) > MEMO:
        memo.clear()
    cut = [PRETOKEN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    every = {p for own in cut for p in own if p not in memo}
    for fresh, count in (([p for p in every if len(p) <= LONG], model.count), ([p for p in every if len(p) > LONG], model.count_long)):
        at = 0
        while at < len(fresh):
            to, chars = at, 0
            while to < len(fresh) and (to == at or chars + len(fresh[to]) <= CHUNK):
                chars += len(fresh[to])
                to += 1
            memo.update(zip(fresh[at:to], count(fresh[at:to]).tolist(), strict=True))
            at = to
    found = [sum(map(memo.__getitem__, own)) for own in cut]
    for p in every:  # long ones would fill the memo
        if len(p) > LONG:
            del memo[p]
    return found


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = counted(texts, path)
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
