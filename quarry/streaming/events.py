"""The stateful operators over streams of events."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A table as a stream of its files; ``ts`` becomes an instant, so that it can bear a watermark."""
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/{name}*").withColumn("ts", F.col("ts").cast("timestamp"))


def once_per_key(events: DataFrame, keys: list[str], ttl: str = "10 minutes") -> DataFrame:
    """The first event of each key within ``ttl``: requests that are repeated count once."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def progress(events: DataFrame, by: list[str], every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Running counts by window and key."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), *by).agg(F.count("*").alias("n"))


BUCKET = "user_id long, limited string, allowed long, refused long"
#: Requests that a user may have in a window of so many seconds, by what is limited: all, and signing in.
LIMITS = {"ALL": (200, 60), "AUTH": (20, 60)}


def rate_limited(requests: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """Requests (``user_id``, ``ts``, ``limited``) allowed and refused per user and limit by token buckets that refill in proportion to the time.

    One state for each: tokens left and the second of the last refill. A trigger's
    requests are counted by second, whatever frames they come in, and a second is one
    step: as many as there are tokens are allowed. Requests of seconds before the last
    refill add no tokens. What ``limits`` doesn't name isn't limited, and left out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        capacity, window_s = limits[key[1]]
        left, last = state.get if state.exists else (capacity, None)
        seconds: Counter = Counter()
        for frame in frames:
            seconds.update((frame["ts"].astype("datetime64[s]").astype("int64")).tolist())
        allowed = 0
        for t in sorted(seconds):
            refill = (t - last) * capacity // window_s if last is not None else 0
            if refill > 0 or last is None:
                left, last = min(capacity, left + refill), t
            taken = min(left, seconds[t])
            left, allowed = left - taken, allowed + taken
        state.update((int(left), int(last)))
        yield pd.DataFrame({"user_id": [key[0]], "limited": [key[1]], "allowed": [allowed], "refused": [seconds.total() - allowed]})

    known = requests.where(F.col("limited").isin(*limits) & F.col("ts").isNotNull())
    return known.groupBy("user_id", "limited").applyInPandasWithState(run, BUCKET, "left long, last long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there, as a table in memory: for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
