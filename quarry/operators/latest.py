"""Latest rows, quotas, pages and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, key: str, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` of each key: an aggregate, combined before the shuffle, where a window would sort all rows."""
    names = keep or [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("__r")).select(key, *(f"__r.{n}" for n in names))


def latest_with_fallback(targets: DataFrame, runs: DataFrame, keys: list[list[str]], order: list[str], keep: list[str]) -> DataFrame:
    """Each target's latest run by the first of several keys that has one (null keys have none)."""
    out, found = targets, []
    for n, cols in enumerate(keys):
        best = runs.dropna(subset=cols).groupBy(*(F.col(c).alias(f"__{n}{c}") for c in cols)).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias(f"__r{n}"))
        on = None
        for c in cols:
            on = (targets[c] == F.col(f"__{n}{c}")) if on is None else on & (targets[c] == F.col(f"__{n}{c}"))
        out = out.join(best, on, "left").drop(*(f"__{n}{c}" for c in cols))
        found.append(F.col(f"__r{n}"))
    return out.withColumn("__r", F.coalesce(*found)).select(*targets.columns, *(F.col(f"__r.{k}").alias(f"run_{k}") for k in keep))


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` in an order with a tie-break."""
    return rows.orderBy(*order).offset(offset).limit(size)


def pool_page_size(target: int) -> int:
    return min(max(10 * target, 30), 300)


def rest_page_size(size: int | None, default: int = 20) -> int:
    return default if size is None else min(max(size, 1), 100)


def page_totals(rows: DataFrame, size: int, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("total_elements")).withColumn("total_pages", F.ceil(F.col("total_elements") / size).cast("long"))


def due_first(sends: DataFrame, as_of: Column, n: int = 1) -> DataFrame:
    """The next sends that are due: those without a time first, then by time and id."""
    due = sends.where((F.col("status") == "QUEUED") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= as_of)))
    return due.orderBy(F.asc_nulls_first("next_attempt_at"), "id").limit(n)


def in_requested_order(rows: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``pos``, their place in a list of keys (``requested``: pos, key); keys without a row are left out."""
    return requested.join(rows, key).orderBy("pos")
