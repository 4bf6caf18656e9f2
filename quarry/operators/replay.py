"""Chains of accepted events: each accepts the first one that comes a certain time after it, and answers those in between.

The chain is followed by pointers that double their reach, within a task and from span to
span of a hot key, so neither that nor a long chain is walked by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .limits import _same, refilled


def accepted_times(events: DataFrame, keys: list[str], at: str, gap: int, most: int | None = None) -> DataFrame:
    """``keys``, ``t``: of each key the first time, then the first one ``gap`` or more after that, and so on.

    ``at`` is a whole number (of seconds, say); rows without one have no part in it.
    Null keys are a key like any other. It is what a bucket of one token is refilled
    at; keys with more than ``most`` events are cut into spans as there.
    """
    return refilled(events, keys, at, 1, gap, most).where("refills").select(*keys, F.col("second").alias("t"))


def replayed(requests: DataFrame, keys: list[str], at: str, id_col: str, ttl: int = 600) -> DataFrame:
    """``requests`` with ``answer``, the id of the request whose answer each gets, and ``replay``, whether that is another one's.

    A key's first request is carried out. Its answer is kept for ``ttl`` and given to
    those that repeat it; the first one after that is carried out anew. Of requests
    at one time the smallest id comes first. A request that lacks a key, or a time,
    is carried out by itself.
    """
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, at)))
    asked = requests.where(known)
    marks = accepted_times(asked, keys, at, ttl)
    bucket = lambda t: F.floor(t / ttl)
    answers = marks.alias("l").join(asked.groupBy(*keys, F.col(at).cast("long").alias("t")).agg(F.min(id_col).alias("answer")).alias("r"), _same(keys, "l", "r") & (F.col("l.t") == F.col("r.t")))
    answers = answers.select(*(F.col(f"l.{k}").alias(f"__{k}") for k in keys), F.col("l.t").alias("__t"), "answer", F.explode(F.array(bucket(F.col("l.t")), bucket(F.col("l.t")) + 1)).alias("__b"))
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__{k}") for k in keys)) & (bucket(F.col(at).cast("long")) == F.col("__b"))
    met = asked.join(answers, on).where((F.col("__t") <= F.col(at)) & (F.col(at) < F.col("__t") + ttl)).drop("__t", "__b", *(f"__{k}" for k in keys))
    return met.unionByName(requests.where(~known).withColumn("answer", F.col(id_col))).withColumn("replay", ~F.col("answer").eqNullSafe(F.col(id_col)))
