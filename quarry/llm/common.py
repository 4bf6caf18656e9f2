"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing that leaves every other letter alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows in one Arrow batch at most: with whole texts in it, ten thousand would be too much for one worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of texts to BATCH_ROWS rows (a smaller setting stays), and let Python workers find this package."""
    place, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if place not in paths.get("PYTHONPATH", "").split(":"):
        paths["PYTHONPATH"] = ":".join(filter(None, (place, paths.get("PYTHONPATH"))))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Paths written in the scopes that are open, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not (context.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path; it goes with the session, or before by ``removed``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, outer: bool = False) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder, its lineage cut.

    Unlike after a checkpoint, its size is known to the optimizer as it is: a loop's
    estimates don't multiply. The table goes when the ``scope`` around it ends (with
    ``outer``, the scope around that one), at the latest with the session.
    """
    table, path = written_at(df)
    scopes = _scopes.get()[: -1 if outer else None]
    if scopes:
        scopes[-1].append(path)
    return table


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at its end."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            removed(spark, path)


def runs_of_bytes(batch: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text each; no row is cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


class KeyFilter:
    """A Bloom filter of longs that are hashes, with a fixed number of bits: a key that was put in always passes.

    Its size doesn't grow with the keys; with very many of them it lets everything
    through, and the join behind it does all the work.
    """

    BITS, CHUNK = 25, 1 << 13

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> KeyFilter:
        """The filter of a column of ``keys``. Its 2 ** (BITS - 6) longs are put together by tasks, and reach the driver as bytes, CHUNK longs in a row."""
        mask = (1 << cls.BITS) - 1

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunks: dict[int, np.ndarray] = {}
            for batch in batches:
                word, bits = batch.column("word").to_numpy(), batch.column("bits").to_numpy().view(np.uint64)
                for n in np.unique(word // cls.CHUNK).tolist():
                    own = word // cls.CHUNK == n
                    chunks.setdefault(n, np.zeros(cls.CHUNK, np.uint64))[word[own] % cls.CHUNK] = bits[own]
            yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array([x.tobytes() for x in chunks.values()], pa.binary())], ["chunk", "words"])

        places = F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(mask)))
        found = keys.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        words = np.zeros(1 << (cls.BITS - 6), dtype=np.uint64)
        for r in found.repartition(F.floor(F.col("word") / cls.CHUNK)).mapInArrow(packed, "chunk long, words binary").collect():
            words[r.chunk * cls.CHUNK : (r.chunk + 1) * cls.CHUNK] = np.frombuffer(r.words, np.uint64)
        return cls(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in it."""
        keys, mask, out = keys.astype(np.int64, copy=False).view(np.uint64), np.uint64((1 << self.BITS) - 1), np.ones(len(keys), dtype=bool)
        for places in (keys & mask, (keys >> np.uint64(32)) & mask):
            out &= (self.words[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


class TwoGenerations:
    """A bounded cache for values that are computed in batches.

    ``have`` holds what was used lately; once it is full it becomes the old
    generation, and the former old one goes. What is looked up moves to ``have``.
    """

    def __init__(self, compute, limit: int, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.have: dict = {}
        self.old: dict = {}

    def load(self, keys: set) -> dict:
        """A mapping that has every one of ``keys``."""
        if len(self.have) > self.limit:
            self.old, self.have = self.have, {}
        have, old = self.have, self.old
        missing = keys - have.keys()
        if old:
            back = missing & old.keys()
            have.update((k, old[k]) for k in back)
            missing -= back
        if not missing:
            return have
        order = list(missing)
        found = dict(zip(order, self.compute(order)))
        long = {k: found.pop(k) for k in order if len(k) > self.longest}
        have.update(found)
        return _Both(have, long) if long else have


class _Both(dict):
    """Lookups in ``long`` where the cache has no such key; long keys aren't kept."""

    def __init__(self, have: dict, long: dict):
        super().__init__(long)
        self.have = have

    def __missing__(self, key):
        return self.have[key]
