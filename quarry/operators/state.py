"""Upserts, claims and transitions as merges of tables: the outcome is a new table, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import after_failure, retry_minutes


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_first: tuple[str, ...] = (), overwrite: tuple[str, ...] | None = None) -> DataFrame:
    """``old`` with the rows of ``new``: known keys take its values, those in ``keep_first`` only where they had none.

    One full outer join on the keys; ``new`` has one row for each key.
    """
    rest = [c for c in old.columns if c not in keys]
    taken = overwrite if overwrite is not None else tuple(c for c in rest if c not in keep_first)
    o, n = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    value = lambda c: (
        F.coalesce(f"o.{c}", f"n.{c}") if c in keep_first else F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in taken else F.when(F.col("__old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    )
    joined = o.join(n, on, "full_outer")
    return joined.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *(value(c).alias(c) for c in rest))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it does not have."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def scan_state(outcomes: DataFrame, now: Column, most_details: int = 2000) -> DataFrame:
    """Rows to keep of what was looked at: a qualified one is never looked at again, others after 30 days."""
    retry = F.when(F.col("outcome") == "QUALIFIED", F.lit(None).cast("timestamp")).otherwise(now + F.expr("INTERVAL 30 DAYS"))
    return outcomes.withColumns({"retry_after": retry, "details": F.substring("details", 1, most_details)})


def default_template(templates: DataFrame, chosen: Column, key: str = "id") -> DataFrame:
    """Exactly one default: the chosen one."""
    return templates.withColumn("is_default", F.col(key).eqNullSafe(chosen))


def enqueue(candidates: DataFrame, blockers: DataFrame, recipient: str = "recipient", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Candidates whose recipient has no blocking send, the first for each recipient."""
    free = candidates.where(F.col(recipient).isNotNull()).join(blockers.select(recipient).distinct(), recipient, "left_anti")
    names = free.columns
    return free.groupBy(F.col(recipient).alias("__k")).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__r")).select("__r.*")


def sweep_stuck(sends: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """Sends that hang for ``minutes`` have an unknown delivery."""
    stuck = (F.col("status") == "SENDING") & (F.col("last_attempt_at") <= as_of - F.expr(f"INTERVAL {minutes} MINUTES"))
    return sends.withColumn("status", F.when(stuck, "DELIVERY_UNKNOWN").otherwise(F.col("status")))


def fail(sends: DataFrame, code: Column, as_of: Column) -> DataFrame:
    """Sends after a failure: status, and the time of the next attempt of those that get one."""
    status = after_failure(code, F.col("attempts"))
    again = as_of + F.make_interval(mins=retry_minutes(F.col("attempts")).cast("int"))
    return sends.withColumns({"status": status, "next_attempt_at": F.when(status == "QUEUED", again)})


def attempts(events: DataFrame, key: str, order: list[str], claimed: Column) -> DataFrame:
    """``events`` with ``attempt``: how many claims of its send there were up to each."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("attempt", F.count_if(claimed).over(so_far))


def update_from(rows: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with the ``columns`` that ``values`` (one row a key) has for their keys; other rows keep theirs."""
    taken = values.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return rows.join(taken, keys, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))


def run_outcome(targets: DataFrame, succeeded: Column, error: Column, now: Column) -> DataFrame:
    """Targets after a run: a success sets its time and clears the error, a failure only sets the error."""
    return targets.withColumns({"last_success_at": F.when(succeeded, now).otherwise(F.col("last_success_at")), "last_error": F.when(succeeded, F.lit(None).cast("string")).otherwise(error)})
