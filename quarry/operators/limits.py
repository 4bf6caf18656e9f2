"""Token buckets over tables of requests: a bucket's seconds are steps, and steps are composed.

With x tokens before, a refill of r and the n requests until the next refill leave
max(0, min(capacity, x + r) - n), which is x + a held between two bounds. Such steps,
one after another, are such a step again.

A task looks at sorted rows of many keys in chunks: in each, refills are found by pointers
that double their reach, and tokens by composing steps in the same way. Keys with
more requests than a task should take are cut into spans of time. What a span does is then
told first, for every request that may be its first refill; those that are follow from
one another, a row for each span, and the spans are gone through all at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized, scope

#: Requests of a key that isn't cut into spans, and rows that are looked at together.
MOST = CHUNK = 1 << 17
#: A span has so many times the time of one token, and so many seconds at least.
TIMES, LEAST = 64, 1 << 16
STEP = "struct<a:bigint,lo:bigint,hi:bigint>"
FAR = 1 << 40


def _held(x: Column, step: Column) -> Column:
    return F.least(F.greatest(x + step["a"], step["lo"]), step["hi"])


def _then(one: Column, two: Column) -> Column:
    """The step that does ``one`` and then ``two``."""
    return F.struct((one["a"] + two["a"]).alias("a"), _held(one["lo"], two).alias("lo"), _held(one["hi"], two).alias("hi"))


def _step(a: Column, lo: Column | int, hi: Column | int) -> Column:
    as_long = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    return F.struct(as_long(a).alias("a"), as_long(lo).alias("lo"), as_long(hi).alias("hi"))


def _before(steps: DataFrame, group: list[str], at: str) -> DataFrame:
    """``group``, ``at``, ``before``: what the steps of a group before each do, all of a group gathered."""
    start = F.struct(_step(F.lit(0), -FAR, FAR).alias("so_far"), F.array().cast(f"array<struct<at:bigint,before:{STEP}>>").alias("out"))
    add = lambda acc, x: F.struct(_then(acc["so_far"], x["step"]).alias("so_far"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), acc["so_far"].alias("before")))).alias("out"))
    gathered = steps.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), "step"))).alias("steps"))
    scanned = gathered.select(*group, F.explode(F.aggregate("steps", start, add)["out"]).alias("o"))
    return scanned.select(*group, F.col("o.at").alias(at), F.col("o.before").alias("before"))


Steps = tuple[np.ndarray, np.ndarray, np.ndarray]


def _composed(one: Steps, two: Steps) -> Steps:
    """``_then`` on arrays."""
    held = lambda x: np.minimum(np.maximum(x + two[0], two[1]), two[2])
    return one[0] + two[0], held(one[1]), held(one[2])


def _spending(n: np.ndarray, capacity: int) -> Steps:
    return -n, np.zeros_like(n), np.maximum(capacity - n, 0)


def _refill(time: np.ndarray, capacity: int, window_s: int) -> np.ndarray:
    """Whole tokens of a time, of which more than ``capacity`` are of no use."""
    return np.where(time >= window_s, capacity, np.minimum(time, window_s) * capacity // window_s)


def _hops(begins: np.ndarray, t: np.ndarray, gap: int) -> np.ndarray:
    """The place of the first row of its group ``gap`` or more after each one, and the number of rows if there is none or the row is beyond the last."""
    steps = np.minimum(np.diff(t, prepend=t[:1]), gap)
    steps[begins] = gap  # so times go on from group to group, and stay small
    at, group = np.cumsum(steps), np.append(np.cumsum(begins), -1)
    hop = np.searchsorted(at, at + gap)
    return np.append(np.where(group[hop] == group[:-1], hop, len(t)), len(t))


def _chain(begins: np.ndarray, hop: np.ndarray) -> np.ndarray:
    """Which rows the first one of each group reaches by hops."""
    hops, end = [hop], len(begins)
    while (hops[-1] < end).any():
        hops.append(hops[-1][hops[-1]])
    at = np.flatnonzero(begins)
    for far in reversed(hops):
        reached = far[at]
        at = np.concatenate([at, reached[reached < end]])
    chain = np.zeros(end, bool)
    chain[at] = True
    return chain


def _scanned(steps: Steps) -> np.ndarray:
    """The tokens after each step; a group's first step leaves the same whatever was there before."""
    a, lo, hi = (x.copy() for x in steps)
    reach = 1
    while (lo < hi).any():
        a[reach:], lo[reach:], hi[reach:] = _composed((a[:-reach], lo[:-reach], hi[:-reach]), (a[reach:], lo[reach:], hi[reach:]))
        reach *= 2
    return lo


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _walked(batches: Iterator[pa.RecordBatch], keys: list[str], capacity: int, window_s: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, with what is allowed and whether they refill the bucket. A group begins full, or with the ``left`` tokens of a first row without requests."""
    gap, last, tokens = -(-window_s // capacity), 0, 0
    for table in _chunks(batches, rows):
        begins, t, n, left = (_column(table, c) for c in ("begins", "second", "n", "left"))
        goes_on = not begins[0]
        if goes_on:
            begins, t, n, left = np.append(True, begins), np.append(last, t), np.append(0, n), np.append(tokens, left)
        refills = _chain(begins, _hops(begins, t, gap))
        at = np.flatnonzero(refills)
        spent, first, full = np.add.reduceat(n, at), begins[at], np.where(left[at] < 0, capacity, left[at])
        more = np.where(first, 0, _refill(np.diff(t[at], prepend=t[:1]), capacity, window_s))
        rest = np.maximum(full - spent, 0)
        after = _scanned((np.where(first, 0, more - spent), np.where(first, rest, 0), np.where(first, rest, np.maximum(capacity - spent, 0))))
        there = np.where(first, full, np.minimum(np.append(0, after[:-1]) + more, capacity))
        part, asked = np.cumsum(refills) - 1, np.cumsum(n) - n
        allowed = np.clip(there[part] - (asked - asked[at][part]), 0, n)
        last, tokens = t[at[-1]], after[-1]
        out = table.select([*keys, "second", "n"]).append_column("allowed", pa.array(allowed[goes_on:])).append_column("refills", pa.array(refills[goes_on:]))
        yield from out.filter(pa.array(n[goes_on:] > 0)).to_batches()


def _entered(batches: Iterator[pa.RecordBatch], keys: list[str], capacity: int, window_s: int, rows: int) -> Iterator[pa.RecordBatch]:
    """For each span and each row that may be its first refill: its time ``t``, the requests before it, the step from its refill to the end, and the last refill ``until``.

    Such a row is the first one, or the one before it comes less than a token's time
    after all that was before the span. A row without ``t`` has all of a span's requests.
    """
    gap = -(-window_s // capacity)
    head, none = None, np.zeros(0, np.int64)

    def told() -> Iterator[pa.RecordBatch]:
        if head is not None:
            out = head.take(pa.array(np.zeros(len(entries) + 1, np.int64)))
            for name, values, end in (("t", entries, None), ("until", until, None), ("asked", before, total), *((c, x, None) for c, x in zip(("a", "lo", "hi"), steps))):
                out = out.append_column(name, pa.concat_arrays([pa.array(values, pa.int64()), pa.array([end], pa.int64())]))
            yield from out.to_batches()

    for table in _chunks(batches, rows):
        begins = _column(table, "begins")
        for i, j in zip(at := np.union1d(np.flatnonzero(begins), [0]), np.append(at[1:], len(begins))):
            t, n = _column(table, "second")[i:j], _column(table, "n")[i:j]
            if begins[i]:
                yield from told()
                head, total, first, near = table.select([*keys, "span"]).slice(i, 1), 0, t[0], True
                entries = until = before = none
                steps = (none, none, none)
            asked = np.append(0, np.cumsum(n))
            hop = _hops(np.arange(j - i) == 0, t, gap)
            ends, there = np.arange(j - i + 1), np.append(t, t[-1])
            a, lo, hi = _spending(asked[hop] - asked, capacity)
            more = np.where(hop < j - i, _refill(there[hop] - there, capacity, window_s), 0)
            own = _composed((a, lo, hi), (more, np.zeros_like(more), np.full_like(more, capacity)))
            own[1][-1], own[2][-1] = -FAR, FAR  # beyond the last row nothing happens
            while (hop < j - i).any():
                own = _composed(own, tuple(x[hop] for x in own))
                ends = np.where(hop < j - i, ends[hop], ends)
                hop = hop[hop]
            # Those of the rows before go on to their next refill, if it is here.
            to = np.searchsorted(t, until + gap)
            steps = _composed(steps, _spending(asked[to], capacity))
            more = np.where(to < j - i, _refill(there[to] - until, capacity, window_s), 0)
            steps = _composed(_composed(steps, (more, np.zeros_like(more), np.full_like(more, capacity))), tuple(x[to] for x in own))
            until = np.where(to < j - i, there[ends[to]], until)
            new = min(j - i, 1 + np.searchsorted(t, first + gap - 1)) if near else 0
            near = t[-1] < first + gap - 1
            entries, until, before = np.append(entries, t[:new]), np.append(until, t[ends[:new]]), np.append(before, total + asked[:new])
            steps = tuple(np.append(x, y[:new]) for x, y in zip(steps, own))
            total += asked[-1]
    yield from told()


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def _next_entries(entries: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """``keys``, ``t``, ``next``: for each entry the first one ``gap`` or more after the last refill that it leads to, if there is one.

    It lies in the next span, where entries and questions are sorted together, or is
    the first of a later one.
    """
    none = F.lit(None).cast("long")
    own = entries.select(*keys, "span", F.col("t").alias("at"), F.col("t").alias("own"), none.alias("asks"), none.alias("of"))
    asks = entries.select(*keys, (F.col("span") + 1).alias("span"), (F.col("until") + gap).alias("at"), none.alias("own"), F.col("t").alias("asks"), F.col("span").alias("of"))
    down = Window.partitionBy(*keys, "span").orderBy(F.col("at").desc(), F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = own.unionByName(asks).withColumn("next", F.last("own", ignorenulls=True).over(down)).where("asks IS NOT NULL").select(*keys, F.col("of").alias("span"), F.col("asks").alias("t"), "next")
    along = Window.partitionBy(*keys).orderBy("span")
    lead = lambda n: F.lead(F.struct("span", "first"), n).over(along)
    later = entries.groupBy(*keys, "span").agg(F.min("t").alias("first")).withColumns({"one": lead(1), "two": lead(2)})
    later = later.select(*keys, "span", F.when(F.col("one.span") > F.col("span") + 1, F.col("one.first")).otherwise(F.col("two.first")).alias("later"))
    found = inside.alias("l").join(later.alias("r"), _same([*keys, "span"], "l", "r"))
    return found.select(*(F.col(f"l.{k}") for k in keys), "t", F.coalesce("next", "later").alias("next"))


def _starts(told: DataFrame, keys: list[str], capacity: int, window_s: int) -> DataFrame:
    """``keys``, ``span``, ``second``, ``n``, ``left``: for each span but a key's first one the last refill before it, and the tokens at its start."""
    gap = -(-window_s // capacity)
    entries = told.where("t IS NOT NULL")
    # Rows with ``next`` are hops, those without are reached; both grow by one round, places in the chain are sums of powers of two.
    both = materialized(_next_entries(entries, keys, gap).where("next IS NOT NULL").unionByName(entries.groupBy(*keys).agg(F.min("t").alias("t")).withColumn("next", F.lit(None).cast("long"))))
    while not (hops := both.where("next IS NOT NULL")).isEmpty():
        met = both.alias("l").join(hops.alias("r"), _same(keys, "l", "r") & (F.coalesce("l.next", "l.t") == F.col("r.t")))
        hop = F.col("l.next").isNotNull()
        met = met.select(*(F.col(f"l.{k}") for k in keys), F.when(hop, F.col("l.t")).otherwise(F.col("r.next")).alias("t"), F.when(hop, F.col("r.next")).alias("next"))
        both = materialized(both.where("next IS NULL").unionByName(met))
    entered = entries.alias("l").join(both.alias("r"), _same(keys, "l", "r") & (F.col("l.t") == F.col("r.t"))).select("l.*")
    # A span's row without ``t`` stands for it if it isn't entered.
    spans = entered.unionByName(told.where("t IS NULL")).groupBy(*keys, "span").agg(F.max_by(F.struct("t", "until", "asked", "a", "lo", "hi"), F.coalesce(F.col("t"), F.lit(-(1 << 62)))).alias("x")).select(*keys, "span", "x.*")
    last = F.last("until", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = materialized(spans.withColumn("last", last))
    time = F.col("t") - F.col("last")
    more = F.coalesce(F.when(time >= window_s, F.lit(capacity)).otherwise(F.expr(f"(t - last) * {capacity} div {window_s}")), F.lit(0))
    spend = _step(-F.col("asked"), 0, F.greatest(F.lit(capacity) - F.col("asked"), F.lit(0)))
    entering = _then(_then(spend, _step(more, 0, capacity)), F.struct("a", "lo", "hi"))
    before = _before(spans.select(*keys, "span", F.when(F.col("t").isNull(), spend).otherwise(entering).alias("step")), keys, "span")
    started = spans.where("last IS NOT NULL").alias("l").join(before.alias("r"), _same([*keys, "span"], "l", "r"))
    return started.select(*(F.col(f"l.{k}") for k in keys), "l.span", F.col("last").alias("second"), F.lit(0).cast("long").alias("n"), _held(F.lit(capacity).cast("long"), F.col("before")).alias("left"))


def refilled(requests: DataFrame, keys: list[str], at: str, capacity: int, window_s: int, most: int | None = None) -> DataFrame:
    """``keys``, ``second``, ``n``, ``allowed``, ``refills``: what a bucket for each key lets through, second by second, and whether it is refilled then.

    Keys with more than ``most`` requests are cut into spans; all other ones go through one task each.
    """
    gap, most = -(-window_s // capacity), MOST if most is None else most
    known = requests.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias("second"))
    schema = lambda df, *more: ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *more])
    order = Window.partitionBy(*keys, "span").orderBy("second")
    begun = lambda df: df.withColumn("begins", F.lag("second").over(order).isNull())
    with scope(requests.sparkSession):
        busy = materialized(known.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys, F.lit(True).alias("busy")), outer=True)
        cut = not busy.isEmpty()
        if cut:
            span = F.when(F.col("busy"), F.floor(F.col("second") / max(TIMES * gap, LEAST)))
            known = known.alias("l").join(busy.alias("r"), _same(keys, "l", "r"), "left").select("l.*", span.alias("span"))
        else:
            known = known.withColumn("span", F.lit(None).cast("long"))
        seconds = known.groupBy(*keys, "span", "second").agg(F.count("*").alias("n"))
        rows = seconds.withColumn("left", F.lit(-1).cast("long"))
        if cut:
            told = begun(seconds.where("span IS NOT NULL")).mapInArrow(partial(_entered, keys=keys, capacity=capacity, window_s=window_s, rows=CHUNK), schema(seconds, *(f"{c} long" for c in ("span", "t", "until", "asked", "a", "lo", "hi"))))
            rows = rows.unionByName(materialized(_starts(materialized(told), keys, capacity, window_s), outer=True))
        return begun(rows).mapInArrow(partial(_walked, keys=keys, capacity=capacity, window_s=window_s, rows=CHUNK), schema(rows, "second long", "n long", "allowed long", "refills boolean"))


def token_buckets(requests: DataFrame, keys: list[str], at: str, capacity: int, window_s: int = 60, most: int | None = None) -> DataFrame:
    """``keys``, ``second``, ``n``, ``allowed``, ``refused``: what a bucket for each key lets through, second by second.

    A bucket begins full. It is refilled at the first request, at least one whole
    token's time after the last refill, with the whole tokens of that time, up to its
    capacity. ``at`` is a time in whole seconds; rows without one are left out, null
    keys are a key. Requests of one second are counted before anything is gathered;
    keys with more than ``most`` requests are cut into spans.
    """
    return refilled(requests, keys, at, capacity, window_s, most).select(*keys, "second", "n", "allowed", (F.col("n") - F.col("allowed")).alias("refused"))
