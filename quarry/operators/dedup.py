"""Duplicates by several keys, in order of priority, and the greedy acceptance of rows that share keys."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized, scope
from .components import connected_components


#: Candidates that share a key from which on its rows are not dealt out by it.
HOT = 100_000


def existing_match(candidates: DataFrame, existing: DataFrame, keys: dict[str, list[str]], id_col: str = "id", hot: int = HOT) -> DataFrame:
    """``candidates`` with ``existing_id`` and ``reason``: the first of ``keys`` (reason: columns) that an existing row shares.

    Each key is one equi-join with a table of least ids by key, so nothing depends on
    a disjunction; null key columns match nothing. Rows are dealt out by a hash of the
    key, those without one by a hash of the whole row. So are rows of keys that more
    than ``hot`` candidates have: of these keys, which are one in ``hot`` rows at most,
    the ids go to all tasks.
    """
    hash_of = lambda cols: F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols)), F.xxhash64(*cols))
    met = candidates.select(F.explode(F.array(*(F.struct(F.lit(n).alias("n"), hash_of(cols).alias("h")) for n, cols in enumerate(keys.values())))).alias("k")).select("k.*").where("h IS NOT NULL")
    crowded = materialized(met.groupBy("n", "h").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("n", "h"))
    kinds = {r.n for r in crowded.select("n").distinct().collect()}
    row = F.xxhash64(*(c for c, kind in candidates.dtypes if "map<" not in kind))
    out, ids, reasons = candidates.withColumn("__row", row), [], []
    for n, (reason, cols) in enumerate(keys.items()):
        named = [F.col(c).alias(f"__{n}_{c}") for c in cols]
        own = existing.where(" AND ".join(f"{c} IS NOT NULL" for c in cols)).groupBy(*named).agg(F.min(id_col).alias(f"__id{n}")).withColumn(f"__to{n}", F.xxhash64(*(f"__{n}_{c}" for c in cols)))
        same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__{n}_{c}") for c in cols))
        out, found = out.withColumn(f"__h{n}", hash_of(cols)), F.lit(None)
        if n in kinds:
            here = crowded.where(F.col("n") == n).select(F.col("h").alias(f"__hot{n}"))
            known = materialized(own.join(F.broadcast(here), F.col(f"__to{n}") == F.col(f"__hot{n}")).select(*(f"__{n}_{c}" for c in cols), F.col(f"__id{n}").alias(f"__far{n}")))
            out = out.join(F.broadcast(here), F.col(f"__h{n}") == F.col(f"__hot{n}"), "left").join(F.broadcast(known), same, "left").drop(*(f"__{n}_{c}" for c in cols))
            out, found = out.withColumn(f"__h{n}", F.when(F.col(f"__hot{n}").isNull(), F.col(f"__h{n}"))).drop(f"__hot{n}"), F.col(f"__far{n}")
        out = out.withColumn(f"__h{n}", F.coalesce(f"__h{n}", "__row"))
        out = out.join(own, (F.col(f"__h{n}") == F.col(f"__to{n}")) & same, "left").drop(f"__h{n}", f"__to{n}", *(f"__{n}_{c}" for c in cols))
        out = out.withColumn(f"__id{n}", F.coalesce(F.col(f"__id{n}"), found)).drop(f"__far{n}")
        ids.append(F.col(f"__id{n}"))
        reasons.append(F.when(F.col(f"__id{n}").isNotNull(), F.lit(reason)))
    return out.withColumns({"existing_id": F.coalesce(*ids), "reason": F.coalesce(*reasons)}).drop("__row", *(f"__id{n}" for n in range(len(keys))))


#: Pairs that a block of ``every_pair`` makes, about.
PAIRS = 2_000_000


def every_pair(left: DataFrame, right: DataFrame, keys: list[str], most: int = PAIRS) -> DataFrame:
    """The pairs of rows with equal ``keys``, as an inner join gives them.

    Their number grows with the product of both sides, so a key's rows of ``left`` are
    cut into blocks that make about ``most`` pairs each with all of ``right``, and the
    blocks are dealt out to as many tasks as the pairs need, not the rows.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = materialized(count(left, "__l").join(count(right, "__r"), keys).select(*keys, F.least(F.ceil(F.col("__l") * F.col("__r") / most), "__l").cast("int").alias("__blocks")))
    tasks = min(10_000, sizes.agg(F.coalesce(F.sum("__blocks"), F.lit(0))).first()[0] + 1)
    one = left.join(sizes, keys).withColumn("__block", F.pmod(F.xxhash64(*left.columns), F.col("__blocks")).cast("int")).drop("__blocks")
    all_ = right.join(sizes, keys).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    dealt = lambda df: df.repartition(tasks, *keys, "__block")
    return dealt(one).join(dealt(all_), [*keys, "__block"]).drop("__block")


def without_existing(candidates: DataFrame, existing: DataFrame, keys: list[tuple[Column, Column]]) -> DataFrame:
    """Candidates that share none of the keys (candidate's, existing row's): an anti-join for each, instead of one with OR."""
    out = candidates
    for n, (own, other) in enumerate(keys):
        known = existing.select(other.alias(f"__k{n}")).where(F.col(f"__k{n}").isNotNull()).distinct()
        out = out.join(known, own == F.col(f"__k{n}"), "left_anti")
    return out


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by an order that has a tie-break."""
    names = rows.columns
    best = F.min_by(F.struct(*names), F.struct(*(o.alias(f"o{n}") for n, o in enumerate(order))))
    return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(best.alias("__r")).select("__r.*")


def seen_before(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """``rows`` with ``seen``: whether an earlier row has the same key."""
    return rows.withColumn("__key", key).withColumn("seen", F.col("__key").isNotNull() & (F.row_number().over(Window.partitionBy("__key").orderBy(*order)) > 1)).drop("__key")


#: Rows of one component that a task decides in one pass.
TOGETHER = 100_000


def greedy_accept(rows: DataFrame, rank: str, keys: list[str], together: int = TOGETHER) -> DataFrame:
    """``rows`` with ``accepted``: what a scan in order of ``rank`` accepts that skips every row sharing a key with an accepted one.

    What the scan says of a row depends on earlier rows of its component alone: those
    that chains of shared keys join it with. First, rows that come first at all their
    keys are accepted and those that meet them dropped, which ends hot keys. The rest
    is contracted into components. The first ``together`` rows of each are scanned in
    one task; then rows of larger components that meet an accepted one are dropped,
    and what is still undecided is contracted again. So rounds are as many as the
    largest component has times ``together`` rows, at most, and one as a rule.
    ``rank`` must be unique; null keys are shared with nobody.
    """
    kind = dict(rows.dtypes)[rank]

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for r, ks in frame.sort_values("r")[["r", "ks"]].itertuples(index=False):
            if taken.isdisjoint(ks):
                taken.update(ks)
                out.append(r)
        return pd.DataFrame({"r": pd.Series(out, dtype=frame["r"].dtype)})

    key = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string")))
    with scope(rows.sparkSession):
        pairs = rows.select(F.col(rank).alias("r"), F.explode(F.array(*map(key, keys))).alias("k")).where("k IS NOT NULL").distinct()
        pairs = materialized(pairs)
        accepted = [rows.select(F.col(rank).alias("r")).join(pairs.select("r").distinct(), "r", "left_anti")]

        def without(undecided: DataFrame, now: DataFrame) -> DataFrame:
            """The rows that share no key with those accepted ``now``, which go, too."""
            met = undecided.join(undecided.join(now, "r", "left_semi").select("k").distinct(), "k", "left_semi").select("r").distinct()
            return undecided.join(met, "r", "left_anti")

        first = pairs.groupBy("k").agg(F.min("r").alias("first"))
        now = materialized(pairs.join(first, "k").groupBy("r").agg(F.min(F.col("r") == F.col("first")).alias("all_first")).where("all_first").select("r"))
        accepted.append(now)
        undecided = materialized(without(pairs, now))
        while not undecided.isEmpty():
            # a collision of hashes makes one component of two, which changes nothing
            node = F.xxhash64(F.lit("row"), "r")
            grouped = undecided.groupBy("r").agg(F.collect_list("k").alias("ks"))
            if undecided.select("r").distinct().count() <= together:  # no component has more rows than there are
                grouped = grouped.select(F.lit(0).cast("long").alias("label"), "r", "ks")
            else:
                labels = connected_components(undecided.select(node.alias("a"), F.xxhash64(F.lit("key"), "k").alias("b")))
                grouped = grouped.join(labels, node == F.col("node")).select("label", "r", "ks")
            ahead = materialized(grouped.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("r"))).where(F.col("n") <= together).drop("n"))
            now = materialized(ahead.groupBy("label").applyInPandas(scan, f"r {kind}"))
            accepted.append(now)
            undecided = materialized(without(undecided.join(ahead.select("r"), "r", "left_anti").unionByName(undecided.join(now, "r", "left_semi")), now))
        joined = materialized(reduce(DataFrame.unionByName, accepted), outer=True).withColumn("accepted", F.lit(True))
    return rows.join(joined, rows[rank] == joined["r"], "left").drop("r").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


#: Kinds of duplicates in a batch, in the order in which they are looked for.
KINDS = ("SOURCE", "PHONE", "INSTAGRAM", "GLOBAL")


def batch_duplicates(rows: DataFrame, pool: DataFrame, leads: DataFrame, rank: str = "rank") -> DataFrame:
    """``rows`` with ``kind``: NONE for those that a scan in order of ``rank`` accepts, else how the first test that fails says.

    ``rows`` and ``pool`` have source, phone, instagram; ``leads`` has phone,
    instagram, global_source, and ``rows`` global_source as well. Tests, in order:
    the source was accepted before or is in the pool (SOURCE); the phone is a lead's
    (GLOBAL), was accepted before or is in the pool (PHONE); so for Instagram
    (INSTAGRAM); the global source is a lead's (GLOBAL). What fails against pool or
    leads never stands in another row's way. Blank keys are none.
    """
    keys = ("source", "phone", "instagram")
    known = rows
    for side, table, columns in (("pool", pool, keys), ("lead", leads, ("phone", "instagram", "global_source"))):
        for c in columns:
            own = table.select(F.trim(c).alias("__k")).where("__k <> ''").distinct().withColumn(f"__{side}_{c}", F.lit(True))
            known = known.join(own, F.col(c) == F.col("__k"), "left").drop("__k")
    has = lambda side, c: F.coalesce(F.col(f"__{side}_{c}"), F.lit(False))
    flags = [*(("pool", c) for c in keys), *(("lead", c) for c in ("phone", "instagram", "global_source"))]
    barred = F.greatest(*(has(*f) for f in flags))
    known = materialized(known.withColumn("__barred", barred))
    accepted = materialized(greedy_accept(known.where("not __barred").select(rank, *keys), rank, list(keys)).where("accepted").select(rank, *keys))
    for c in keys:
        first = accepted.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__k")).agg(F.min(rank).alias(f"__first_{c}"))
        known = known.join(first, F.col(c) == F.col("__k"), "left").drop("__k")
    seen = lambda c: F.coalesce(F.col(f"__first_{c}") < F.col(rank), F.lit(False))
    kind = F.when(seen("source") | has("pool", "source"), "SOURCE")
    for c in ("phone", "instagram"):
        kind = kind.when(has("lead", c), "GLOBAL").when(seen(c) | has("pool", c), c.upper())
    kind = kind.when(has("lead", "global_source"), "GLOBAL").otherwise("NONE")
    return known.withColumn("kind", kind).drop("__barred", *(f"__{a}_{c}" for a, c in flags), *(f"__first_{c}" for c in keys))


def duplicate_counters(rows: DataFrame) -> DataFrame:
    """One row: duplicates by phone, by Instagram and of any other kind, and their sum."""
    counts = rows.agg(F.count_if(F.col("kind") == "PHONE").alias("duplicate_phone"), F.count_if(F.col("kind") == "INSTAGRAM").alias("duplicate_instagram"), F.count_if(F.col("kind").isin("SOURCE", "GLOBAL")).alias("duplicate_source"))
    return counts.withColumn("duplicates", F.col("duplicate_phone") + F.col("duplicate_instagram") + F.col("duplicate_source"))


def accept_quota(rows: DataFrame, rank: str, keys: list[str], quota: int, eligible: Column | None = None) -> DataFrame:
    """``rows`` with ``outcome``: QUALIFIED for the first ``quota`` accepted, OVER_QUOTA for further ones, DUPLICATE or INELIGIBLE.

    Ineligible rows never stand in others' way; one that shares a key with an
    accepted row before it counts as a duplicate.
    """
    ok = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    judged = greedy_accept(rows.where(ok), rank, keys).select(F.col(rank).alias("__r"), "accepted")
    order = judged.where("accepted").select("__r").orderBy("__r").limit(quota).withColumn("within", F.lit(True))
    known = rows.join(judged, F.col(rank) == F.col("__r"), "left").drop("__r").join(order, F.col(rank) == F.col("__r"), "left").drop("__r")
    firsts = known.where("accepted")
    for n, k in enumerate(keys):
        least = firsts.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"__k{n}")).agg(F.min(rank).alias(f"__f{n}"))
        known = known.join(least, F.col(k) == F.col(f"__k{n}"), "left").drop(f"__k{n}")
    shared = F.coalesce(F.least(*(F.col(f"__f{n}") for n in range(len(keys))), F.lit(None).cast("long")) < F.col(rank), F.lit(False))
    outcome = F.when(F.col("within"), "QUALIFIED").when(F.col("accepted"), "OVER_QUOTA").when(shared | F.col("accepted").isNotNull(), "DUPLICATE").otherwise("INELIGIBLE")
    return known.withColumn("outcome", outcome).drop("accepted", "within", *(f"__f{n}" for n in range(len(keys))))
