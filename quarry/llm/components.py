"""Connected components of a graph given as a table of edges.

Random contraction: in each round every node picks, among itself and its
neighbours, the one with the lowest hash, and merges into it. The number of nodes
that still have an edge falls by a constant factor a round on average, so a few
dozen rounds do for any graph, long chains included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scope, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` for every node of ``edges`` (``a``, ``b``, longs).

    Nodes of one component share a label, which is one of its nodes. Null ends,
    loops and repeated edges are passed over.
    """
    with scope(edges.sparkSession):
        first = live = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b and a is not null").distinct())
        merges: list[DataFrame] = []
        while not live.isEmpty():
            rank = lambda c: F.struct(F.xxhash64(F.lit(len(merges)), F.col(c)).alias("h"), F.col(c).alias("v"))
            both = live.select(F.explode(F.array(F.struct(F.col("a").alias("u"), rank("b").alias("w")), F.struct(F.col("b").alias("u"), rank("a").alias("w")))).alias("e")).select("e.u", "e.w")
            into = written(both.groupBy("u").agg(F.min("w").alias("w")).select("u", F.least("w", rank("u"))["v"].alias("to")))
            merges.append(into)
            live = written(
                live.join(into.select(F.col("u").alias("a"), F.col("to").alias("a2")), "a")
                .join(into.select(F.col("u").alias("b"), F.col("to").alias("b2")), "b")
                .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
                .where("a < b")
                .distinct()
            )
        labels = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
        for into in merges:
            labels = labels.join(into.select(F.col("u").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        return written(labels, outer=True)
