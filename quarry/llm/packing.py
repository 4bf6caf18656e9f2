"""Sum-of-squares online packing into token windows.

Each task packs the documents of its partition as they come. A level array holds,
for every fill level, how many windows stand at it. A document longer than a window
first fills windows of its own; what is left goes to the level where the sum of the
squared counts of partly filled windows becomes least, or into a new window. At the
end of the partition the windows still open are joined through the same level array:
the fullest one takes the fullest others that it has room for. If at most WASTE of it
stays free it is closed. The others are taken apart, and their pieces joined likewise;
only the few windows that nothing fits then are cut, and one window of a partition at
most is padded by more.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, runs_of_bytes, small_batches

#: Chunks whose ids one worker keeps, in each of two generations.
KEPT_CHUNKS = 300_000
#: Share of a window that may stay free when nothing else fits into it.
WASTE = 0.02
#: Bits of a sequence id below the partition's number.
LOCAL_BITS = 40


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space between words, so a text's ids are those of its
    parts between ASCII white space, one after another; parts seen lately are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        self.cache = TwoGenerations(self.encode_chunks, KEPT_CHUNKS)

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        out = []
        for lo in range(0, len(chunks), 4096):
            part = [c.decode("utf-8", "replace") for c in chunks[lo : lo + 4096]]
            got = self.model.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(part)))).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # the tokenizer lower-cases; A-Z beforehand saves chunks, but the strings of special tokens are matched as they stand
        parts = [(t if b"<|" in t else t.lower()).split() for t in texts]
        ids = self.cache.load(set().union(*parts) if parts else set())
        return [b"".join(map(ids.__getitem__, p)) for p in parts]


@cache
def encoder(path: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path)


class Levels:
    """The level array: how many windows stand at each fill, and the pieces in them."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.windows: dict[int, list[list]] = {}

    def best(self, s: int) -> int:
        """The level, 0 for a new window, that an item of size ``s`` goes to; the fuller one in a tie."""
        n, size = self.count, self.size
        here = n[1 : size - s + 1]
        after = 2 * n[s + 1 : size + 1] + 1
        after[-1:] = 0  # a full window is no longer partly filled
        change = np.where(here > 0, after - 2 * here + 1, np.iinfo(np.int64).max)
        new = 2 * n[s] + 1
        if not len(change):
            return 0
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        return at + 1 if change[at] <= new else 0

    def place(self, s: int, piece) -> list | None:
        """Put an item of size ``s`` (below the window's) somewhere; the window if that filled it."""
        level = self.best(s)
        window = []
        if level:
            window = self.windows[level].pop()
            self.count[level] -= 1
        window.append(piece)
        if level + s == self.size:
            return window
        self.windows.setdefault(level + s, []).append(window)
        self.count[level + s] += 1
        return None

    def take(self, most: int) -> list | None:
        """Take out a window of the highest level up to ``most``."""
        levels = np.flatnonzero(self.count[1 : most + 1])
        if not len(levels):
            return None
        level = int(levels[-1]) + 1
        self.count[level] -= 1
        return self.windows[level].pop()

    def closed(self, waste: int) -> Iterator[tuple[list, bool]]:
        """The windows still open, joined as far as they fit whole, and whether one is full but for ``waste``.

        Those that nothing fits are taken apart, and their pieces are joined likewise.
        """
        for last in (False, True):
            apart = []
            while (window := self.take(self.size)) is not None:
                free = self.size - sum(len(p[2]) // 4 for p in window)
                while free > waste and (more := self.take(free)) is not None:
                    free -= sum(len(p[2]) // 4 for p in more)
                    window = window + more
                if free <= waste or last:
                    yield window, free <= waste
                else:
                    apart += window
            for piece in apart:
                level = len(piece[2]) // 4
                self.windows.setdefault(level, []).append([piece])
                self.count[level] += 1


def pack_ids(ids: Iterator[tuple[object, bytes]], size: int, first: int) -> Iterator[tuple]:
    """Rows (id, start, length, crc, document's tokens, sequence, offset) for documents given as bytes of their ids."""
    levels, sequence = Levels(size), first

    def rows(window: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, data, total in window:
            n = len(data) // 4
            yield doc, start, n, zlib.crc32(data), total, sequence, offset
            offset += n

    for doc, data in ids:
        total, start = len(data) // 4, 0
        while total - start >= size:
            yield from rows([(doc, start, data[4 * start : 4 * (start + size)], total)])
            sequence, start = sequence + 1, start + size
        if start < total:
            full = levels.place(total - start, (doc, start, data[4 * start :], total))
            if full:
                yield from rows(full)
                sequence += 1
    window, fill = [], 0
    for left, whole in levels.closed(int(WASTE * size)):
        if whole:
            yield from rows(left)
            sequence += 1
            continue
        for doc, start, data, total in left:
            while data:
                take = min(len(data) // 4, size - fill)
                window.append((doc, start, data[: 4 * take], total))
                data, start, fill = data[4 * take :], start + take, fill + take
                if fill == size:
                    yield from rows(window)
                    sequence, window, fill = sequence + 1, [], 0
    if window:
        yield from rows(window)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its tokens and ``end_id``; a null or empty text is ``end_id``
    alone. Each token lies in exactly one piece. A sequence's number is the
    partition's number followed by a running number in it, so that a lost partition,
    packed anew from the same rows, gets the same sequences. Null ids and repeated
    rows are packed as they come; an empty table gives an empty result; other
    columns are left out. Nothing is shuffled; a task holds its open windows only.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    names = ["i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        types = [None]

        def ids() -> Iterator[tuple[object, bytes]]:
            for batch in batches:
                types[0] = batch.schema.field("i").type
                for part in runs_of_bytes(batch, "t"):
                    texts = [t or b"" for t in part.column("t").to_pylist()]
                    yield from zip(part.column("i").to_pylist(), (x + end for x in model.encode(texts)))

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=types[0]), *(pa.array(c, type=pa.int64()) for c in cols[1:])], names)

        rows: list[tuple] = []
        for row in pack_ids(ids(), size, TaskContext.get().partitionId() << LOCAL_BITS):
            rows.append(row)
            if len(rows) == 10_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    schema = f"i {kind}, " + ", ".join(f"{n} long" for n in names[1:])
    return rows.mapInArrow(run, schema).withColumnRenamed("i", id_col)
