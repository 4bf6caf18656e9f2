"""Sharding by sampled splitters: shards of near-equal size from a range partition.

A document's key is a hash of its text with a few salt bits below it, so that equal
texts are neighbours, and yet a group of copies of any size can be cut. Splitters
are quantiles of a sample of keys, drawn with a chance in proportion to size (in bytes,
and as a row).
Counting what fell into each range shows the overfull ones, which are subdivided;
exact sums over the final ranges then say where each shard begins, and only a range
with a boundary in it is divided between two shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Low bits of a key that salt copies of one text.
SALT_BITS = 20
#: Keys sampled for each range, on average.
SAMPLE = 8
#: Ranges for each shard at least, and rows that a range should hold at most.
RANGES_PER_SHARD = 24
RANGE_ROWS = 250_000


def splitters(keyed: DataFrame, ranges: int, rows: int, total: int, seed: int) -> np.ndarray:
    """Quantile boundaries of about ``ranges * SAMPLE`` keys, drawn in proportion to a document's share of bytes and of rows.

    Half of the weight is a row's whatever its size, so that many small documents,
    copies among them, get as many splitters as they have rows. The sample that
    reaches the driver grows with the number of ranges only.
    """
    share = F.col("size") * F.lit(0.5 / max(total, 1)) + F.lit(0.5 / max(rows, 1))
    chance = F.least(F.lit(1.0), share * F.lit(float(ranges * SAMPLE)))
    drawn = keyed.where(F.rand(seed) < chance).select("key", (share / chance).alias("weight")).toPandas()
    drawn = drawn.sort_values("key", kind="stable")
    reached = drawn["weight"].cumsum().to_numpy()
    if not len(reached):
        return np.empty(0, dtype=np.int64)
    wanted = reached[-1] * np.arange(1, ranges) / ranges
    return np.unique(drawn["key"].to_numpy(dtype=np.int64)[np.minimum(np.searchsorted(reached, wanted), len(drawn) - 1)])


def subdivided(cuts: np.ndarray, rows: np.ndarray, size: np.ndarray, most_rows: int, most_size: float) -> np.ndarray:
    """``cuts`` with more of them, evenly spaced, in each range that holds too much."""
    lo, hi = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    edges = [lo, *cuts.tolist(), hi]
    more = []
    for k in range(len(edges) - 1):
        parts = min(int(max(np.ceil(rows[k] / most_rows), np.ceil(size[k] / most_size))), edges[k + 1] - edges[k])
        more += [edges[k] + (edges[k + 1] - edges[k]) * i // parts for i in range(1, parts)]
    return np.unique(np.array([*cuts.tolist(), *more], dtype=np.int64))


def with_range(keyed: DataFrame, cuts: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype("int32"))

    return keyed.withColumn("range", of("key"))


def totals(ranged: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bytes of each of ``n`` ranges: as many numbers as there are ranges."""
    rows, size = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for r in ranged.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect():
        rows[r["range"]], size[r["range"]] = r["rows"], r["size"]
    return rows, size


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. Shard sizes differ by
    about one document's size at most, as only the document on a boundary can't be
    cut. Slots run from 0 without a gap in each shard. Copies of a text stand
    together and share a shard unless a boundary falls among them. Null texts count
    as empty; null ids and repeated rows are kept as they come; an empty table gives
    an empty result; other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << SALT_BITS) - 1))
    keyed = written(
        docs.select(
            F.col(id_col).alias("i"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).bitwiseAND(F.lit(-1 << SALT_BITS)).bitwiseOR(salt).alias("key"),
        )
    )
    all_rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * RANGES_PER_SHARD, -(-all_rows // RANGE_ROWS))
    cuts = splitters(keyed, ranges, all_rows, total, seed)
    rows, size = totals(with_range(keyed, cuts), len(cuts) + 1)
    finer = subdivided(cuts, rows, size, max(1, min(RANGE_ROWS, 2 * all_rows // ranges + 1)), max(1.0, 2 * total / ranges))
    ranged = with_range(keyed, finer)
    rows, size = totals(ranged, len(finer) + 1)

    # where each range begins, in rows and in bytes: one number a range
    start = docs.sparkSession.createDataFrame(
        pd.DataFrame({"range": np.arange(len(rows), dtype="int32"), "row0": np.cumsum(rows) - rows, "byte0": np.cumsum(size) - size}), "range int, row0 long, byte0 long"
    )
    order = Window.partitionBy("range").orderBy("key", "i", "size", "text_crc32")
    placed = ranged.withColumns({"nth": F.row_number().over(order) - 1, "before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")})
    middle = F.col("byte0") + F.col("before") + F.expr("size div 2")
    whole = (middle.cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(38,0)")).cast("int")
    placed = written(placed.join(F.broadcast(start), "range").select("i", "size", "text_crc32", F.least(whole, F.lit(shards - 1)).alias("shard"), (F.col("row0") + F.col("nth")).alias("row")))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(F.col("i").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
