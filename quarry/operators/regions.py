"""Regions: boxes split into quarters as long as they are large, and extracts checked for what they refer to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..sources.tables import materialized, scope

BOX = ("south", "west", "north", "east")


def can_split(depth: Column, box: dict[str, Column], most_depth: int, least_km: float) -> Column:
    """Whether a box is above the last depth and longer than ``least_km`` along one of its middle lines."""
    lat, lon = (box["south"] + box["north"]) / 2, (box["west"] + box["east"]) / 2
    tall, wide = haversine_km(box["south"], lon, box["north"], lon), haversine_km(lat, box["west"], lat, box["east"])
    return (depth < most_depth) & ((tall > least_km) | (wide > least_km))


def split_regions(boxes: DataFrame, most_depth: int, least_km: float) -> DataFrame:
    """``boxes`` (south, west, north, east, ``lat``, ``lon``: the city's middle, and any others) and all their parts, with ``depth``, ``km`` from the city's middle and ``leaf``.

    A box that can be split has four quarters; those without an area are left out. All
    boxes of a depth are split at once, so there are ``most_depth`` rounds at most.
    """
    of = {c: F.col(c) for c in BOX}
    lat, lon = (of["south"] + of["north"]) / 2, (of["west"] + of["east"]) / 2
    quarter = lambda s, w, n, e: F.struct(s.alias("south"), w.alias("west"), n.alias("north"), e.alias("east"))
    quarters = F.array(quarter(of["south"], of["west"], lat, lon), quarter(of["south"], lon, lat, of["east"]), quarter(lat, of["west"], of["north"], lon), quarter(lat, lon, of["north"], of["east"]))
    judged = lambda df, depth: df.withColumns({"depth": F.lit(depth), "km": haversine_km(F.col("lat"), F.col("lon"), lat, lon), "leaf": ~can_split(F.lit(depth), of, most_depth, least_km)})
    others = [c for c in boxes.columns if c not in BOX]
    levels = [judged(boxes, 0)]
    for depth in range(1, most_depth + 1):
        parts = levels[-1].where("not leaf").select(*others, F.explode(quarters).alias("q")).select(*others, *(F.col(f"q.{c}") for c in BOX)).where("south < north and west < east")
        levels.append(judged(parts, depth))
    return reduce(lambda a, b: a.unionByName(b), levels)


KEYS = ["type", "id"]


def missing_references(elements: DataFrame, references: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``roots`` (``type``, ``id``) lead to along ``references`` (``type``, ``id``, ``to_type``, ``to_id``): the elements that are there, and the references to those that aren't.

    Relations name ways, nodes and other relations, ways name nodes; an extract is
    closed if nothing is missing. Each round follows the references of all elements
    found in the last one, so there are as many as relations are nested; circles end.
    """
    kinds = lambda df, c: [r[0] for r in df.select(c).distinct().collect()]  # noqa: E731, a few: nodes, ways, relations
    with scope(elements.sparkSession):
        there = elements.select(F.col("type").alias("to_type"), F.col("id").alias("to_id"))
        named = roots.select(F.col("type").alias("to_type"), F.col("id").alias("to_id")).distinct()
        found = front = materialized(named.join(there, ["to_type", "to_id"], "left_semi").select(F.col("to_type").alias("type"), F.col("to_id").alias("id")))
        missing = []
        while not front.isEmpty():
            # only tables of the kinds at hand are read, and elements are met once
            led = materialized(references.where(F.col("type").isin(kinds(front, "type"))).select(*KEYS, "to_type", "to_id").join(front, KEYS).distinct())
            known = there.where(F.col("to_type").isin(kinds(led, "to_type"))).distinct().withColumn("there", F.lit(True))
            led = materialized(led.join(known, ["to_type", "to_id"], "left"))
            missing.append(led.where("there IS NULL").select(*KEYS, "to_type", "to_id"))
            front = materialized(led.where("there").select(F.col("to_type").alias("type"), F.col("to_id").alias("id")).distinct().join(found, KEYS, "left_anti"))
            found = materialized(found.unionByName(front))
        none = references.select(*KEYS, "to_type", "to_id").limit(0)
        lost = materialized(reduce(lambda a, b: a.unionByName(b), missing, none).distinct(), outer=True)
        return materialized(found, outer=True), lost
