"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch stand in one flat array of symbols with an
array of lengths. In each round every sequence finds the lowest merge rank among
its neighbouring pairs and applies it at all its places at once; a sequence with no
pair left is done, and what survives of it are its tokens. Long sequences would need
as many rounds as they have different ranks, each over all of them; theirs are taken
rank by rank from an index of places by rank, and only pairs beside a merge are
looked up anew, so the work grows with the merges. Text comes in chunks
(a run without white space, with the one space before it) whose counts don't depend
on what stands around them, so counts of chunks seen lately are kept.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, runs_of_bytes, small_batches

#: The white space of the pre-tokenizer's pattern (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NONE = np.iinfo(np.int64).max
#: Chunks whose counts one worker keeps, in each of two generations.
KEPT_CHUNKS = 250_000
#: Symbols from which on a sequence counts as long.
LONG = 65


class MergeTable:
    """Merge rules as sorted arrays: pair key, rank, merged symbol."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.base = np.int64(max(vocab.values()) + 1)
        key = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in rules], dtype=np.int64)
        into = np.array([vocab[a + b] for a, b in rules], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.into = key[order], order.astype(np.int64), into[order]
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.letters = np.zeros(0x200, dtype=np.int64)  # byte-level letters lie below U+0200
        for letter, i in vocab.items():
            if len(letter) == 1 and ord(letter) < len(self.letters):
                self.letters[ord(letter)] = i
        self.pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.cache = TwoGenerations(self.count_chunks, KEPT_CHUNKS)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair's rule stands in the sorted arrays, -1 without a rule."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def long_lengths(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``merged_lengths`` for long sequences: linked places, and an index of them by the rank of their pair."""
        n = len(symbols)
        symbols = np.append(symbols, 0)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # n stands for no place
        after[ends - 1] = n
        before[np.append(0, ends[:-1])] = n
        before[n] = n
        rank = np.full(n + 1, NONE)
        alive = np.ones(n, dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def look_up(at: np.ndarray) -> None:
            rule = self.find(symbols[at], symbols[after[at]])
            found = np.where((rule >= 0) & (after[at] < n), self.rank[rule], NONE)
            rank[at] = found
            at, found = at[found < NONE], found[found < NONE]
            order = np.argsort(found, kind="stable")
            values, first = np.unique(found[order], return_index=True)
            for value, group in zip(values.tolist(), np.split(at[order], first[1:])):
                if value not in places:
                    places[value] = []
                    heapq.heappush(waiting, value)
                places[value].append(group)

        look_up(np.arange(n))
        while waiting:
            lowest = heapq.heappop(waiting)
            chosen = np.unique(np.concatenate(places.pop(lowest)))
            chosen = chosen[rank[chosen] == lowest]
            if not len(chosen):
                continue
            first = np.ones(len(chosen), dtype=bool)
            first[1:] = after[chosen[:-1]] != chosen[1:]
            chosen = chosen[self.every_other(first)]
            symbols[chosen] = self.into[self.find(symbols[chosen], symbols[after[chosen]])]
            gone = after[chosen]
            alive[gone], rank[gone] = False, NONE
            after[chosen] = after[gone]
            before[after[chosen]] = chosen
            beside = before[chosen]
            look_up(np.unique(np.concatenate([chosen, beside[beside < n]])))
        return np.add.reduceat(alive, ends - lengths, dtype=np.int64)

    @staticmethod
    def every_other(first: np.ndarray) -> np.ndarray:
        """Of each run of neighbouring places, which begins where ``first`` is true, the first, third and so on."""
        index = np.arange(len(first))
        return (index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0

    def merged_lengths(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive in each sequence; every length is 1 or more."""
        out = lengths.copy()
        long = lengths >= LONG
        if long.any():
            out[long] = self.long_lengths(symbols[np.repeat(long, lengths)], lengths[long])
        short = (lengths > 1) & ~long
        live = np.flatnonzero(short)
        symbols = symbols[np.repeat(short, lengths)]
        lengths = lengths[live]
        while len(live):
            starts = np.cumsum(lengths) - lengths
            inside = np.ones(len(symbols), dtype=bool)
            inside[starts + lengths - 1] = False
            at = np.flatnonzero(inside)
            rule = self.find(symbols[at], symbols[at + 1])
            rank = np.full(len(symbols), NONE)
            rank[at] = np.where(rule >= 0, self.rank[rule], NONE)
            best = np.minimum.reduceat(rank, starts)
            chosen = np.flatnonzero((rank == np.repeat(best, lengths)) & (rank < NONE))
            # the same pair may overlap itself (aaa): of neighbouring places every other one merges
            first = np.ones(len(chosen), dtype=bool)
            first[1:] = np.diff(chosen) != 1
            chosen = chosen[self.every_other(first)]
            where = np.searchsorted(at, chosen)
            symbols[chosen] = self.into[rule[where]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[chosen + 1] = False
            lengths = np.add.reduceat(stay, starts, dtype=np.int64)
            symbols = symbols[stay]
            more = (best < NONE) & (lengths > 1)
            out[live] = lengths
            symbols, live, lengths = symbols[np.repeat(more, lengths)], live[more], lengths[more]
        return out

    def count_chunks(self, chunks: list[str]) -> list[int]:
        parts = [[p for p, _ in self.pieces(c)] for c in chunks]
        flat = [p for ps in parts for p in ps]
        if not flat:
            return [0] * len(chunks)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        letters = np.frombuffer("".join(flat).encode("utf-32-le"), dtype=np.uint32)
        merged = self.merged_lengths(self.letters[letters], lengths)
        ends = np.cumsum([0, *map(len, parts)])
        total = np.concatenate([[0], np.cumsum(merged)])
        return (total[ends[1:]] - total[ends[:-1]]).tolist()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special token's string counts as that one token."""
        cut = [self.split.split(t) if self.split and any(s in t for s in self.special) else [t] for t in texts]
        chunks = [[c for part in parts for c in CHUNK.findall(part)] for parts in cut]
        counts = self.cache.load(set().union(*chunks) if chunks else set())
        return [sum(map(counts.__getitem__, cs)) + len(parts) - 1 for cs, parts in zip(chunks, cut)]


@cache
def merge_table(path: str) -> MergeTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return MergeTable(path)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``tokenizer``: the place of a byte-level BPE file on every machine. A null text
    counts as empty (0 bytes, 0 tokens); null ids and repeated rows are kept as they
    come; an empty table gives an empty result; other columns are left out. Nothing
    is shuffled: each task counts its own rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merge_table(tokenizer)
        for batch in batches:
            for part in runs_of_bytes(batch, "t"):
                texts = [t or "" for t in part.column("t").to_pylist()]
                n = np.array(model.count(texts), dtype=np.int64)
                size = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(size), pa.array(n), pa.array(n > limit)], ["i", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"i {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("i", id_col)
