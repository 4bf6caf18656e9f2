"""Vector code compression: a codebook for each part of the vectors, by Lloyd's algorithm with Hamerly's bounds.

All is done in integers, so results are exact. A vector keeps, for each part, its
entry, an upper bound of the distance to it and one lower bound of the distance to
the second nearest entry. Entries that move loosen the bounds by as much as they
moved. Only where the upper bound isn't strictly below the lower one, or below half
the way to the nearest other entry, are all entries looked at, and then the lowest
of the nearest is taken. Bounds are kept in a table from round to round, with the
sums of each task, so a lost executor costs no more than its tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, small_batches, written_at

#: Parts of a vector, entries of a codebook, rounds, and integer steps of a component of 1.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bounds are widened by this much for the rounding of their square roots and sums.
SLACK = 1e-12


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def cuts(size: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end: equal ones if ``parts`` divides its size."""
    return [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]


def square(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact, along the last axis."""
    return ((x - entries) ** 2).sum(axis=-1)


def above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


class Book:
    """The entries of one part, how far each moved at most, and half the way from each to its nearest neighbour at least."""

    def __init__(self, entries: np.ndarray, former: np.ndarray | None = None):
        self.entries = entries
        self.moved = above(square(entries, former)) if former is not None else np.zeros(len(entries))
        apart = below(square(entries[:, None], entries[None]))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2
        # what the others moved, at most: the farthest that isn't the entry itself
        far = np.argsort(self.moved)[::-1]
        self.others = np.full(len(entries), self.moved[far[0]])
        self.others[far[0]] = self.moved[far[1]] if len(far) > 1 else 0.0

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings entries and bounds of the rows of ``x`` up to date, in place; how many rows needed a full scan."""
        upper[:] = (upper + self.moved[code]) * (1 + SLACK)
        lower[:] = (lower - self.others[code]) * (1 - SLACK) - SLACK
        safe = np.maximum(lower, self.half[code])
        rows = np.flatnonzero(~(upper < safe))
        upper[rows] = above(square(x[rows], self.entries[code[rows]]))
        rows = rows[~(upper[rows] < safe[rows])]
        for some in np.array_split(rows, len(rows) // 8192 + 1):
            squares = square(x[some][:, None], self.entries[None])
            code[some] = squares.argmin(axis=1)  # the first of equal ones
            nearest = np.sort(squares, axis=1)
            upper[some] = above(nearest[:, 0])
            lower[some] = below(nearest[:, 1]) if nearest.shape[1] > 1 else np.inf
        return len(rows)


def lists(values: np.ndarray) -> pa.Array:
    """A row of a matrix each as a list."""
    n, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(values.reshape(-1)))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def assigned(rows: DataFrame, size: int, books: list[Book], first: bool) -> DataFrame:
    """``rows`` (``id``, ``label``, ``v``, and ``code``, ``upper``, ``lower`` unless it is the ``first`` round) under ``books``.

    A task ends with a row that has nothing but ``sums``: for each part and entry how many parts it has and
    their sums, and then the number of full scans.
    """
    small_batches(rows.sparkSession)
    where = cuts(size, len(books))
    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, v array<int>, code array<int>, upper array<double>, lower array<double>, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        sums = [np.zeros(b.entries.shape, np.int64) for b in books]
        scans, last = 0, None
        for batch in batches:
            n = batch.num_rows
            x = matrix(batch.column("v"), size).astype(np.int64)
            if first:  # bounds that say nothing
                code, upper, lower = np.zeros((n, len(books)), np.int32), np.full((n, len(books)), np.inf), np.zeros((n, len(books)))
            else:
                code, upper, lower = (matrix(batch.column(c), len(books)).copy() for c in ("code", "upper", "lower"))
            for p, (book, (lo, hi)) in enumerate(zip(books, where)):
                own = np.ascontiguousarray(code[:, p]), np.ascontiguousarray(upper[:, p]), np.ascontiguousarray(lower[:, p])
                scans += book.assign(x[:, lo:hi], *own)
                code[:, p], upper[:, p], lower[:, p] = own
                counts[p] += np.bincount(own[0], minlength=len(counts[p]))
                np.add.at(sums[p], own[0], x[:, lo:hi])
            last = batch
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), lists(code), lists(upper), lists(lower), pa.nulls(n, pa.list_(pa.int64()))], ["id", "label", "v", "code", "upper", "lower", "sums"])
        if last is not None:
            flat = np.concatenate([*(np.column_stack([c, s]).reshape(-1) for c, s in zip(counts, sums)), [scans]])
            none = [pa.nulls(1, last.column(c).type) for c in ("id", "label", "v")]
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.list_(pa.int32())), *[pa.nulls(1, pa.list_(pa.float64()))] * 2, lists(flat[None])], ["id", "label", "v", "code", "upper", "lower", "sums"])

    return rows.mapInArrow(run, schema)


def totals(state: DataFrame) -> list[int]:
    """The sums of all tasks: numbers of parts x entries x (1 + components) + 1, whatever the input."""
    each = state.where("sums is not null").select(F.posexplode("sums").alias("at", "x"))
    return [int(r.x) for r in each.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).orderBy("at").collect()]


def moved_books(books: list[Book], sums: list[int]) -> list[Book]:
    """Entries at the floors of their parts' means; unused ones stay."""
    out, at = [], 0
    for book in books:
        k, m = book.entries.shape
        rows = np.array([sums[at + i * (m + 1) : at + (i + 1) * (m + 1)] for i in range(k)], dtype=object).reshape(k, m + 1)
        entries = [[int(s) // int(r[0]) for s in r[1:]] if r[0] else old for r, old in zip(rows, book.entries.tolist())]
        out.append(Book(np.array(entries, np.int64).reshape(k, m), book.entries))
        at += k * (m + 1)
    return out


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, scans: list[int] | None = None) -> DataFrame:
    """One row per kept vector: id, ``code`` (an array of entries), ``error``, ``label_error`` and ``codebooks``, their text.

    Kept are vectors whose components are all there and finite, as many as the
    vector of the smallest id has. Components become floors of ``scale`` times
    themselves. Codebooks start with the vectors of the ``entries`` smallest ids
    (fewer, if there are no more; ties by vector, null ids last), take ``rounds``
    steps, and then all parts are assigned again. ``error`` is the sum of squared
    distances, ``label_error`` that of all with the label, nulls together. Vectors
    whose size ``parts`` doesn't divide are cut as evenly as can be. Integers beyond
    the size that keeps all distances in a long (2 ** 27 for 64 components) count as
    that. Repeated rows are kept; an empty table gives an empty result; other columns
    are left out. ``scans`` gets the number of full scans of each assignment.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.where(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    first = rows.orderBy(F.col("id").isNull(), "id", "x").select("x")
    size = len(one.x) if (one := first.first()) else 0
    start = [r.x for r in first.where(F.size("x") == size).limit(entries).collect()]
    most = float(math.isqrt((1 << 62) // max(size, 1)) // 2)
    integer = lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * scale))).cast("int")
    kept = rows.where(F.size("x") == size).select("id", "label", F.transform("x", integer).alias("v"))
    seeds = np.array([[math.floor(max(-most, min(most, v * scale))) for v in x] for x in start], np.int64).reshape(len(start), size)
    books = [Book(seeds[:, lo:hi]) for lo, hi in cuts(size, parts)] if start else [Book(np.zeros((1, 0), np.int64))] * parts
    state, path = written_at(assigned(kept, size, books, first=True))
    for _ in range(rounds):
        sums = totals(state)
        if not sums:
            break
        if scans is not None:
            scans.append(sums[-1])
        books = moved_books(books, sums)
        former = path
        state, path = written_at(assigned(state.where("sums is null"), size, books, first=False))
        removed(spark, former)
    if scans is not None:
        scans.append((totals(state) or [0])[-1])
    codebooks = ",".join(str(v) for book in books for entry in book.entries.tolist() for v in entry)
    own = errors(state.where("sums is null").select("id", "label", "v", "code"), size, books)
    # a third of all vectors may have one label: sums are made before they are moved
    by_label = own.groupBy(F.col("label").alias("of")).agg(F.coalesce(F.try_sum("error"), F.lit((1 << 63) - 1)).alias("label_error"))
    out = own.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks).alias("codebooks"))


def errors(rows: DataFrame, size: int, books: list[Book]) -> DataFrame:
    """``id``, ``label``, ``code`` and ``error`` of every vector."""
    where, kinds = cuts(size, len(books)), dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, code = matrix(batch.column("v"), size).astype(np.int64), matrix(batch.column("code"), len(books))
            error = sum((square(x[:, lo:hi], book.entries[code[:, p]]) for p, (book, (lo, hi)) in enumerate(zip(books, where))), np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("code"), pa.array(error)], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long")


def digest(codebooks: str) -> str:
    return hashlib.sha256(codebooks.encode()).hexdigest()
