"""Substring dedup by a compacted de Bruijn graph of token k-mers.

The k-mers are all windows of ``window`` words: each is an edge from its first
window - 1 words to its last ones. They are never shuffled one by one. A window's
anchor is its short k-mer (ANCHOR words) of the least hash, which depends on the
window alone; windows in a row with one anchor travel as one edge. If all edges of
an anchor, anywhere, are equal, or an edge stands in an earlier document, these
edges say all about their windows. Only the others (near an edit, or near an end of
a repeated passage) are taken apart into single windows.

Repeated edges whose neighbours don't branch and lie side by side in their source,
the first document that has them, become paths by joins with pointer doubling. A
document's edges on a path, at one displacement, are one span if the source's
coordinates leave no hole in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, removed, runs_of_bytes, scope, small_batches, written, written_at

#: Words of a window, and of its anchor.
WINDOW, ANCHOR = 50, 13
#: Odd multipliers of the two rolling hashes, any odd numbers of 64 bits.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Longs whose bits all depend on all bits of ``x``."""
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any run of a text's words, two of 64 bits each, from running sums modulo 2 ** 64."""

    def __init__(self, words: list[bytes]):
        from xxhash import xxh64_intdigest

        self.n = len(words)
        codes = np.fromiter((xxh64_intdigest(w, 42) for w in words), np.uint64, self.n)
        self.sums, self.back = [], []
        for odd, lane in zip(ODD, (codes, mixed(codes ^ np.uint64(ODD[1])))):
            up, down = (np.full(self.n + 1, x, np.uint64) for x in (odd, pow(odd, -1, 1 << 64)))
            up[0] = down[0] = 1
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(lane * np.cumprod(up)[:-1], out=sums[1:])
            self.sums.append(sums)
            self.back.append(np.cumprod(down))

    def of(self, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
        """Hashes of the words from each start up to its end; equal runs at different places have equal ones."""
        found = (self.sums[lane][ends] - self.sums[lane][starts]) * self.back[lane][starts]
        return mixed(found + (ends - starts).astype(np.uint64) * np.uint64(ODD[0]))


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` hashes in a row, the place of the least (of its upper half, the first of equal ones)."""
    y = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    out, reach = len(hashes) - width + 1, 1
    while 2 * reach <= width:
        y = np.minimum(y[:-reach], y[reach:])
        reach *= 2
    return (np.minimum(y[:out], y[width - reach : width - reach + out]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def edges_of(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...] | None:
    """``start``, ``n``, ``anchor`` and the hashes ``a``, ``b`` of a text's edges: runs of ``n`` windows with one anchor. None without a window."""
    if len(words) < window:
        return None
    rolling = Rolling(words)
    at = np.arange(len(words) - anchor + 1)
    kmers = rolling.of(at, at + anchor, 0)
    least = least_places(kmers, window - anchor + 1)
    start = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    n = np.diff(np.concatenate([start, [len(least)]]))
    return start, n, kmers[least[start]], *(rolling.of(start, start + n + window - 1, lane) for lane in (0, 1))


def edges(docs: DataFrame, kind: str, window: int, anchor: int) -> DataFrame:
    """``id``, ``key`` and the edges (see ``edges_of``) of all rows of ``docs`` (``id``, ``key``, ``t``), with ``next_a`` of the text's next edge."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of_bytes(batch, "t"):
                found = [(row, x) for row, t in enumerate(part.column("t").to_pylist()) if (x := edges_of((t or b"").split(), window, anchor))]
                if found:
                    owner = np.repeat([row for row, _ in found], [len(x[0]) for _, x in found])
                    start, n, kmer, a, b = (np.concatenate(c) for c in zip(*(x for _, x in found)))
                    last = np.append(owner[1:] != owner[:-1], True)
                    of, signed = pa.array(owner), lambda x, mask=None: pa.array(x.view(np.int64), mask=mask)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(of), part.column("key").take(of), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), signed(kmer), signed(a), signed(b), signed(np.roll(a, -1), last)], ["id", "key", "start", "n", "anchor", "a", "b", "next_a"])

    return docs.mapInArrow(run, f"id {kind}, key long, start int, n int, anchor long, a long, b long, next_a long")


def single_windows(docs: DataFrame, kind: str, window: int) -> DataFrame:
    """``id``, ``key``, ``start``, ``n`` (1), ``a``, ``b`` of the windows that start in ``ranges`` (``start``, ``n``) of each row of ``docs``."""
    small_batches(docs.sparkSession)

    def windows(words: list[bytes], ranges: list[dict]) -> Iterator[tuple[np.ndarray, ...]]:
        at = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in ranges]))
        for own in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):  # only words of these windows are hashed
            rolling, start = Rolling(words[own[0] : own[-1] + window]), own - own[0]
            yield own, *(rolling.of(start, start + window, lane) for lane in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of_bytes(batch, "t"):
                found = [(row, x) for row, (t, ranges) in enumerate(zip(part.column("t").to_pylist(), part.column("ranges").to_pylist())) for x in windows(t.split(), ranges)]
                if found:
                    of = pa.array(np.repeat([row for row, _ in found], [len(x[0]) for _, x in found]))
                    start, a, b = (np.concatenate(c) for c in zip(*(x for _, x in found)))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(of), part.column("key").take(of), pa.array(start.astype(np.int32)), pa.array(np.ones(len(start), np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["id", "key", "start", "n", "a", "b"])

    return docs.mapInArrow(run, f"id {kind}, key long, start int, n int, a long, b long")


def repeated(found: DataFrame) -> DataFrame:
    """Edges that two documents have: ``a``, ``b`` and the ``source`` (``id``, ``start``), the first place of the least id."""
    return found.groupBy("a", "b").agg(F.min(F.struct("id", "start")).alias("source"), F.max("id").alias("last")).where(F.col("source.id") < F.col("last")).drop("last")


def mixed_anchors(found: DataFrame) -> DataFrame:
    """``anchor`` of those whose edges in two documents are not all equal."""
    differ = lambda c: F.min(c) < F.max(c)
    return found.groupBy("anchor").agg((differ("id") & (differ("a") | differ("b"))).alias("mixed")).where("mixed")


def paths(met: DataFrame, known: DataFrame) -> DataFrame:
    """``a``, ``b`` of each repeated edge with its path: ``head_a``, ``head_b``, and ``offset``, windows from the path's beginning.

    An edge goes on to the next if no document with a repeated edge behind it goes
    anywhere else, none comes from anywhere else, and both lie side by side in one
    source. Such paths have no cycles. Each round doubles the reach of the pointers.
    """
    both = met.where("next_a is not null").select("a", "b", "next_a", "n", F.col("source").alias("from")).distinct()
    both = written(both.join(known.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("source").alias("to")), "next_a"))
    single = lambda c: F.min(c) == F.max(c)
    ahead = both.groupBy("a", "b").agg((single("next_a") & single("next_b")).alias("one")).where("one").drop("one")
    behind = both.groupBy("next_a", "next_b").agg((single("a") & single("b")).alias("one")).where("one").drop("one")
    side = (F.col("from.id") == F.col("to.id")) & (F.col("from.start") + F.col("n") == F.col("to.start"))
    links = both.where(side).join(ahead, ["a", "b"], "left_semi").join(behind, ["next_a", "next_b"], "left_semi")
    at = written(links.select(F.col("next_a").alias("a"), F.col("next_b").alias("b"), F.col("a").alias("head_a"), F.col("b").alias("head_b"), F.col("n").cast("long").alias("offset"), F.lit(True).alias("moved")))
    while not at.where("moved").isEmpty():
        further = at.select(F.col("a").alias("head_a"), F.col("b").alias("head_b"), F.col("head_a").alias("far_a"), F.col("head_b").alias("far_b"), F.col("offset").alias("more"))
        step = at.join(further, ["head_a", "head_b"], "left")
        at = written(step.select("a", "b", F.coalesce("far_a", "head_a").alias("head_a"), F.coalesce("far_b", "head_b").alias("head_b"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("far_a").isNotNull().alias("moved")))
    return at.drop("moved")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``id``, ``key`` (a hash of the text), ``start``, ``n``, ``source``: runs of ``n`` windows that start in a document of a smaller id.

    ``source`` (``id``, ``start``) is where the first of them stands there. Spans of
    one document may overlap or lie side by side.
    """
    kind = dict(docs.dtypes)[id_col]
    with scope(docs.sparkSession):
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("t"))
        runs, path = written_at(edges(rows, kind, window, anchor))
        known, mixed = written(repeated(runs)), written(mixed_anchors(runs))
        # what stays: edges that are repeated, and those of which single windows may be
        met = written(runs.join(known, ["a", "b"], "left").join(mixed, "anchor", "left").drop("anchor").where("source is not null or mixed"))
        removed(docs.sparkSession, path)
        earlier = F.coalesce(F.col("source.id") < F.col("id"), F.lit(False))
        ranges = written(met.where(F.col("mixed") & ~earlier).groupBy("id", "key").agg(F.collect_set(F.struct("start", "n")).alias("ranges")))
        asked = rows.where(has(KeyFilter.of(ranges, "key"), "key"))
        singles = written(single_windows(asked.join(ranges, ["id", "key"]).select("id", "key", "t", "ranges"), kind, window))
        alone = singles.join(written(repeated(singles)), ["a", "b"]).where(earlier).select("id", "key", "start", "n", "source")

        met = met.where("source is not null").drop("mixed")
        units = met.where(earlier).join(paths(met, known), ["a", "b"], "left")
        place = F.col("start") - F.coalesce("offset", F.lit(0))
        lines = units.groupBy("id", "key", F.coalesce("head_a", "a").alias("head_a"), F.coalesce("head_b", "b").alias("head_b"), place.alias("place")).agg(F.collect_set(F.struct("start", "n", "source")).alias("parts"))
        first, extent = F.array_min("parts"), F.array_max(F.transform("parts", lambda x: x["start"] + x["n"]))
        whole = F.aggregate("parts", F.lit(0), lambda a, x: a + x["n"]) == extent - first["start"]
        one = F.struct(first["start"].alias("start"), (extent - first["start"]).alias("n"), first["source"].alias("source"))
        found = lines.select("id", "key", F.explode(F.when(whole, F.array(one)).otherwise(F.col("parts"))).alias("s")).select("id", "key", "s.start", "s.n", "s.source")
        return written(found.unionByName(alone), outer=True)


def has(known: KeyFilter, column: str) -> Column:
    """Whether the filter may have a row's ``column``."""
    return F.pandas_udf(lambda key: pd.Series(known.has(key.to_numpy())), "boolean")(column)


def kept_words(words: list[bytes], ranges: list[dict] | None, window: int) -> list[bytes]:
    """The words that no window of ``ranges`` covers."""
    if not ranges:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        change[r["start"]] += 1
        change[r["start"] + r["n"] + window - 1] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed`` and ``text``, the words that stay, with one blank between them.

    A word goes if a window of ``window`` words covers it that also starts in a
    document with a smaller id. All are judged on the input. Words are what ASCII
    white space separates, unchanged; a null text has none. A document without an id
    comes neither before nor after others: nothing goes from it, or because of it.
    Rows that share an id are no source for one another; repeated rows are kept, each
    with its result. Texts of fewer words than a window stay whole. An empty table
    gives an empty result; other columns are left out.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of_bytes(batch, "t"):
                words = [(t or b"").split() for t in part.column("t").to_pylist()]
                kept = [kept_words(w, r, window) for w, r in zip(words, part.column("ranges").to_pylist())]
                sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (words, kept)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes[0]), pa.array(sizes[0] - sizes[1]), pa.array([b" ".join(x) for x in kept])], ["id", "n_words", "n_removed", "text"])

    gone = spans(docs, id_col, text_col, window, anchor).groupBy("id", "key").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
    gone = written(gone)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("t")).withColumn("asked", has(KeyFilter.of(gone, "key"), "key"))
    # only documents that may lose words are moved to the join
    met = rows.where("asked").join(gone, ["id", "key"], "left").select("id", "t", "ranges")
    calm = rows.where("not asked").select("id", "t", F.lit(None).cast("array<struct<start:int,n:int>>").alias("ranges"))
    done = calm.unionByName(met).mapInArrow(run, f"id {kind}, n_words long, n_removed long, text binary")
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("text").cast("string").alias("text"))
