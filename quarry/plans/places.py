"""Queries over regions, extracts and shown rows.

Boxes are nations', elements of an extract customers (relations of relations), orders
(relations), line items (ways) and parts (nodes), leads customers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import regions, responses
from ..sources.tables import table
from .crm import pick, query, sql_pick


def _sql_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


_LAT, _LON = "((south + north) / 2)", "((west + east) / 2)"


@query(
    f"""WITH RECURSIVE b AS (SELECT n_nationkey AS id, 0 AS depth, lat - 0.18 AS south, lon - 0.18 AS west, lat + 0.18 AS north, lon + 0.18 AS east, lat, lon FROM (SELECT n_nationkey, (n_nationkey * 3.0 - 40)::DOUBLE AS lat, (n_nationkey * 5.0 - 60)::DOUBLE AS lon FROM nation)
  UNION ALL SELECT id, depth + 1, CASE WHEN q < 2 THEN south ELSE {_LAT} END, CASE WHEN q % 2 = 0 THEN west ELSE {_LON} END, CASE WHEN q < 2 THEN {_LAT} ELSE north END, CASE WHEN q % 2 = 0 THEN {_LON} ELSE east END, lat, lon
    FROM b, (SELECT unnest([0, 1, 2, 3]) AS q) WHERE depth < 3 AND ({_sql_km('south', _LON, 'north', _LON)} > 9 OR {_sql_km(_LAT, 'west', _LAT, 'east')} > 9))
  SELECT id, depth, round(south, 6) AS south, round(west, 6) AS west, round(north, 6) AS north, round(east, 6) AS east, round({_sql_km('lat', 'lon', _LAT, _LON)}, 3) AS km,
    NOT (depth < 3 AND ({_sql_km('south', _LON, 'north', _LON)} > 9 OR {_sql_km(_LAT, 'west', _LAT, 'east')} > 9)) AS leaf FROM b"""
)
def region_quadtree(spark, d):
    """Every nation's box and its parts, down to those too small to be split."""
    n = F.col("n_nationkey")
    middle = table(spark, d, "nation").select(n.alias("id"), (n * F.lit(3.0) - 40).alias("lat"), (n * F.lit(5.0) - 60).alias("lon"))
    boxes = middle.withColumn("box", geo.around(F.col("lat"), F.col("lon"))).select("id", "lat", "lon", "box.*")
    out = regions.split_regions(boxes, most_depth=3, least_km=9)
    return out.select("id", "depth", *(F.round(c, 6).alias(c) for c in regions.BOX), F.round("km", 3).alias("km"), "leaf")


def extract(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Elements and references; some line items and parts are left out of the elements."""
    orders, lines, parts = table(spark, d, "orders"), table(spark, d, "lineitem").withColumn("way", F.col("l_orderkey") * 10 + F.col("l_linenumber")), table(spark, d, "part")
    of = lambda df, kind, c: df.select(F.lit(kind).alias("type"), F.col(c).cast("long").alias("id"))
    elements = [of(orders, "relation", "o_orderkey"), of(lines.where("l_quantity < 49"), "way", "way"), of(parts.where("p_partkey % 10 <> 3"), "node", "p_partkey"), of(table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("c")), "relation", "c")]
    to = lambda df, kind, c, to_kind, t: df.select(F.lit(kind).alias("type"), F.col(c).cast("long").alias("id"), F.lit(to_kind).alias("to_type"), F.col(t).cast("long").alias("to_id"))
    references = [to(orders.withColumn("c", -1 - F.col("o_custkey")), "relation", "c", "relation", "o_orderkey"), to(lines, "relation", "l_orderkey", "way", "way"), to(lines, "way", "way", "node", "l_partkey")]
    return tuple(reduce(lambda a, b: a.unionByName(b), x) for x in (elements, references))


_LINES = "(SELECT *, l_orderkey * 10 + l_linenumber AS way FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 20 = 0)"


@query(
    f"""WITH l AS {_LINES}, there AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS way FROM lineitem WHERE l_quantity < 49)
  SELECT 'relation' AS type, l_orderkey AS id, 'way' AS to_type, way AS to_id FROM l WHERE way NOT IN (FROM there) UNION SELECT 'way', way, 'node', l_partkey FROM l WHERE way IN (FROM there) AND l_partkey % 10 = 3"""
)
def boundary_missing(spark, d):
    """What an extract around every twentieth customer refers to and doesn't have."""
    elements, references = extract(spark, d)
    return regions.missing_references(elements, references, elements.where("type = 'relation' and id < 0 and (-1 - id) % 20 = 0"))[1]


STATES = ("NEW", "SENT", "APPROVED")


@query(
    f"""SELECT c_custkey AS lead_id, c_name AS business_name, {sql_pick(STATES, 'c_custkey')} AS status, s_name AS campaign_name, l.doc_id IS NOT NULL AS analyzed, quality AS opportunity_score, md5(d.text) AS message, d.lang = 'en' AS edited
  FROM customer LEFT JOIN labels l ON l.doc_id = c_custkey LEFT JOIN documents d ON d.doc_id = c_custkey LEFT JOIN supplier ON s_suppkey = CASE WHEN c_custkey % 3 > 0 THEN c_custkey // 3 END"""
)
def lead_details(spark, d):
    """Leads with their analysis, message and campaign."""
    k = F.col("c_custkey")
    leads = table(spark, d, "customer").select(k.alias("lead_id"), F.col("c_name").alias("business_name"), pick(STATES, k).alias("status"), F.when(k % 3 > 0, F.floor(k / 3)).alias("current_campaign_id"))
    analyses = table(spark, d, "labels").select(F.col("doc_id").alias("lead_id"), F.col("quality").alias("opportunity_score"))
    messages = table(spark, d, "documents").select(F.col("doc_id").alias("lead_id"), F.md5("text").alias("message_text"), (F.col("lang") == "en").alias("edited"))
    out = responses.lead_responses(leads, analyses, messages, table(spark, d, "supplier").select(F.col("s_suppkey").alias("campaign_id"), F.col("s_name").alias("name")))
    return out.select("lead_id", "business_name", "status", "campaign_name", F.col("analysis").isNotNull().alias("analyzed"), F.col("analysis.opportunity_score"), F.col("message.message_text").alias("message"), F.col("message.edited"))


@query(
    """SELECT o_orderkey AS run_id, o_custkey AS region_id, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 9 END AS target_id, o_orderstatus AS status, c_name AS city, n_name AS state, r_name AS country
  FROM orders LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON o_custkey = c_custkey AND c_custkey % 5 > 0"""
)
def run_details(spark, d):
    """Runs with the names of their region."""
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("region_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 9).alias("target_id"), F.col("o_orderstatus").alias("status"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    named = table(spark, d, "customer").where("c_custkey % 5 > 0").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return responses.run_responses(runs, named.select(F.col("c_custkey").alias("region_id"), F.col("c_name").alias("city"), F.col("n_name").alias("state"), F.col("r_name").alias("country")))
