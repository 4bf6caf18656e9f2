from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import regions, responses


def test_boxes_are_split_until_they_are_small(spark):
    one = spark.createDataFrame([(1, -0.1, -0.1, 0.1, 0.1, 0.0, 0.0), (2, 5.0, 5.0, 5.01, 5.01, 5.0, 5.0), (3, 1.0, 1.0, 1.0, 2.0, 1.0, 1.0)], "id long, south double, west double, north double, east double, lat double, lon double")
    got = regions.split_regions(one, most_depth=4, least_km=6).collect()
    count = lambda i, d: sum(r.id == i and r.depth == d for r in got)
    assert [count(1, d) for d in range(5)] == [1, 4, 16, 0, 0]  # 22 km, 11 km, 5.6 km
    assert count(2, 0) == 1 and count(2, 1) == 0 and [r.leaf for r in got if r.id == 2] == [True]
    assert count(3, 0) == 1 and count(3, 1) == 0  # a line has no quarters
    assert all(r.leaf == (r.depth == 2) for r in got if r.id == 1)
    leaves = [r for r in got if r.id == 1 and r.leaf]
    assert abs(sum((r.north - r.south) * (r.east - r.west) for r in leaves) - 0.04) < 1e-9
    assert regions.split_regions(one.limit(0), 3, 1).count() == 0


def test_extracts_are_closed_or_not(spark):
    elements = [("relation", 100), ("way", 200), ("node", 1), ("node", 2), ("relation", 101), ("relation", 102), ("way", 900), ("way", 900)]
    references = [("relation", 100, "way", 200), ("relation", 100, "way", 201), ("way", 200, "node", 1), ("way", 200, "node", 3), ("relation", 100, "relation", 101), ("relation", 101, "relation", 102), ("relation", 102, "relation", 100), ("relation", 102, "node", 2), ("way", 900, "node", 77)]
    e, r = spark.createDataFrame(elements, "type string, id long"), spark.createDataFrame(references, "type string, id long, to_type string, to_id long")
    found, missing = regions.missing_references(e, r, spark.createDataFrame([("relation", 100), ("relation", 5)], "type string, id long"))
    assert {tuple(x) for x in found.collect()} == {("relation", 100), ("way", 200), ("relation", 101), ("relation", 102), ("node", 1), ("node", 2)}
    assert {tuple(x) for x in missing.collect()} == {("relation", 100, "way", 201), ("way", 200, "node", 3)}
    found, missing = regions.missing_references(e, r, e.limit(0))
    assert found.count() == missing.count() == 0


def test_rows_as_they_are_shown(spark):
    leads = spark.createDataFrame([(1, 7), (2, 8), (3, None), (None, 7)], "lead_id long, current_campaign_id long")
    some = spark.createDataFrame([(1, "x"), (None, "y")], "lead_id long, business_type string")
    messages = spark.createDataFrame([(2, None)], "lead_id long, message_text string")
    got = {r.lead_id: r for r in responses.lead_responses(leads, some, messages, spark.createDataFrame([(7, "seven"), (9, None)], "campaign_id long, name string")).collect()}
    assert got[1].analysis.business_type == "x" and got[1].message is None and got[1].campaign_name == "seven"
    assert got[2].analysis is None and got[2].message is not None and got[2].campaign_name is None and got[None].analysis is None
    runs = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "run_id long, region_id long")
    got = {r.run_id: (r.city, r.state) for r in responses.run_responses(runs, spark.createDataFrame([(5, "c", None, "k")], "region_id long, city string, state string, country string")).collect()}
    assert got == {1: ("c", None), 2: (None, None), 3: (None, None)}


def test_addresses_have_a_host(spark):
    rows = {" a.example/x ": "https://a.example/x", "HTTP://b.example": "HTTP://b.example", "http://": None, "": None, " ": None, None: None, "https:///path": None, "no host here": None}
    got = spark.createDataFrame([(k,) for k in rows], "u string").select("u", text.normalize_url(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in got} == rows


def test_only_references_of_the_kinds_at_hand_are_read(spark):
    elements = spark.createDataFrame([("relation", 1), ("way", 2)], "type string, id long")
    of = lambda kind, to: spark.range(1).selectExpr(f"'{kind}' AS type", "id + 1 AS id", "'way' AS to_type", f"{to} AS to_id")
    references = of("relation", "id + 3").unionByName(of("node", "IF(id = 0, CAST(raise_error('a node was read') AS BIGINT), id)"))
    found, missing = regions.missing_references(elements, references, elements.where("id = 1"))
    assert found.count() == 1 and [tuple(r) for r in missing.collect()] == [("relation", 1, "way", 3)]
