import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import dedup, funnel, messaging, niches, state
from quarry.sources import tables
from quarry.sources.tables import append, publish, table
from quarry.streaming import events


def greedy(rows, keys):
    taken, out = set(), {}
    for r in sorted(rows):
        own = {(k, v) for k, v in zip(keys, r[1:]) if v is not None}
        out[r[0]] = not own & taken
        if out[r[0]]:
            taken |= own
    return out


def test_greedy_acceptance_equals_a_scan(spark):
    rng = random.Random(2)
    for size in (1, 40, 150):
        rows = [(n, rng.choice([None, *range(size // 2 + 1)]), rng.choice([None, *range(size // 3 + 1)])) for n in range(size)]
        df = spark.createDataFrame(rows, "rank long, phone long, instagram long")
        got = {r["rank"]: r["accepted"] for r in dedup.greedy_accept(df, "rank", ["phone", "instagram"]).collect()}
        assert got == greedy(rows, ("phone", "instagram"))
    empty = spark.createDataFrame([], "rank long, phone long, instagram long")
    assert dedup.greedy_accept(empty, "rank", ["phone", "instagram"]).count() == 0


def test_quota_and_ineligible_rows(spark):
    rows = [(1, "a", True), (2, "a", True), (3, "b", False), (4, "b", True), (5, "c", True), (6, "a", False)]
    df = spark.createDataFrame(rows, "rank long, phone string, ok boolean")
    got = {r["rank"]: r["outcome"] for r in dedup.accept_quota(df, "rank", ["phone"], 2, F.col("ok")).collect()}
    assert got == {1: "QUALIFIED", 2: "DUPLICATE", 3: "INELIGIBLE", 4: "QUALIFIED", 5: "OVER_QUOTA", 6: "DUPLICATE"}


def test_two_stage_confirmation(spark):
    rows = [(1, {"shop": "beauty"}, "Studio Bella beleza", "NONE"), (2, {"shop": "beauty"}, "Manicure Pedicure Alongamento Nail Design", "OFFICIAL_TEXT"), (3, {"shop": "beauty", "beauty": "nails"}, "", "TAG_STRONG")]
    df = spark.createDataFrame([(i, t, "", x) for i, t, x, _ in rows], "id long, tags map<string,string>, name string, official_text string")
    got = niches.classify(df, niches.BY_NAME["nails"]).collect()
    assert [r["evidence"] for r in sorted(got)] == [w for *_, w in rows] and all(r["potential"] for r in got)


def test_tiers(spark):
    for tags, wanted in (({"phone": "1", "instagram": "a"}, 1), ({"phone": "1", "website": "a"}, 2), ({"website": "a", "facebook": "b"}, 3), ({"website": "a"}, 4), ({"phone": "1"}, 5), ({"website": " "}, 5)):
        df = spark.createDataFrame([(tags,)], "tags map<string,string>")
        assert df.select(niches.priority_tier(F.col("tags"))).first()[0] == wanted


def test_registered_niches():
    assert len(niches.NICHES) == 20 and len({a for n in niches.NICHES for a in n.aliases}) > 110
    assert all(set(n.evidence) <= set(n.aliases) for n in niches.NICHES)


def test_eligibility_order(spark):
    c = F.lit
    none = F.lit(None).cast("string")
    cases = [((c(False), c(True), none, none, none, none), "WRONG_CAMPAIGN"), ((c(True), c(True), none, none, none, none), "DO_NOT_CONTACT"), ((c(True), c(False), c(" "), none, none, none), "NO_PHONE"), ((c(True), c(False), c("1"), none, none, none), "INVALID_PHONE"), ((c(True), c(False), c("1"), c("2"), c("SENT"), c("QUEUED")), "ALREADY_SENT"), ((c(True), c(False), c("1"), c("2"), none, c("QUEUED")), "ALREADY_QUEUED"), ((c(True), c(False), c("1"), c("2"), none, none), None)]
    for args, wanted in cases:
        assert spark.range(1).select(funnel.eligibility(*args)).first()[0] == wanted


def test_templates_have_one_default(spark):
    df = state.default_template(spark.createDataFrame([(1, True), (2, True), (3, False)], "id long, is_default boolean"), F.lit(3))
    assert [r["is_default"] for r in df.orderBy("id").collect()] == [False, False, True]


def test_publish_and_append(spark, tmp_path):
    publish(spark.range(3), str(tmp_path / "t.parquet"))
    append(spark.range(2), str(tmp_path / "t.parquet"))
    assert table(spark, str(tmp_path), "t").count() == 5


def test_streams_agree_with_the_tables(spark, sf_dir, tmp_path):
    stream = events.read_events(spark, sf_dir)
    batch = table(spark, sf_dir, "events")
    once = events.drained(events.once_per_key(stream, ["event_id"]), "once", str(tmp_path / "a"))
    assert once.count() == batch.select("event_id").distinct().count()
    hourly = events.drained(events.progress(stream, ["event_type"]), "hourly", str(tmp_path / "b"), "complete")
    assert hourly.agg(F.sum("n")).first()[0] == batch.count()


def test_a_long_chain_of_shared_keys(spark):
    """106 rows, each sharing a key with the next: every other one is accepted, however far the chain goes."""
    rows = spark.createDataFrame([(n, f"p{n // 2}", f"i{(n + 1) // 2}") for n in range(1, 107)], "rank long, phone string, instagram string")
    got = {r["rank"]: r["accepted"] for r in dedup.greedy_accept(rows, "rank", ["phone", "instagram"]).collect()}
    assert got == {n: n % 2 == 1 for n in range(1, 107)}


def test_batch_duplicates_by_kind(spark):
    """Source before phone before Instagram; a lead's key is GLOBAL; what is a duplicate stands in nobody's way."""
    rows = [(1, "node/1", "55", "a"), (2, "node/1", "56", "b"), (3, "node/3", "55", "c"), (4, "node/4", "57", "a"), (5, "node/5", "90", "d"), (6, "node/6", None, "z"), (7, "node/7", "91", "e"), (8, "node/8", "56", "b"), (9, "node/9", None, None), (10, "node/10", "92", "d")]
    df = spark.createDataFrame([(*r, f"openstreetmap_{r[1]}") for r in rows], "rank long, source string, phone string, instagram string, global_source string")
    pool = spark.createDataFrame([("node/7", "70", None)], "source string, phone string, instagram string")
    leads = spark.createDataFrame([("90", "z", " "), (" ", None, "openstreetmap_node/9")], "phone string, instagram string, global_source string")
    got = {r["rank"]: r["kind"] for r in dedup.batch_duplicates(df, pool, leads).collect()}
    assert got == {1: "NONE", 2: "SOURCE", 3: "PHONE", 4: "INSTAGRAM", 5: "GLOBAL", 6: "GLOBAL", 7: "SOURCE", 8: "NONE", 9: "GLOBAL", 10: "NONE"}
    assert dedup.duplicate_counters(dedup.batch_duplicates(df, pool, leads)).first().asDict() == {"duplicate_phone": 1, "duplicate_instagram": 1, "duplicate_source": 5, "duplicates": 7}


def test_publish_replaces_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.publish(spark.range(3), path)
    tables.publish(spark.range(10, 12), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    broken = spark.range(3).selectExpr("raise_error('no') AS x")
    with pytest.raises(Exception):
        tables.publish(broken, path)
    assert spark.read.parquet(path).count() == 2


def test_blocking_sends_of_other_campaigns(spark):
    """A recipient that another campaign has written to is blocked under any lead; the own campaign comes first."""
    leads = spark.createDataFrame([(1, "11999990000", None, False), (2, "+55 11 99999-0000", None, False), (3, "123", None, False), (4, None, None, False), (5, "11988887777", None, True), (6, "11977776666", None, False)], "lead_id long, phone string, country string, do_not_contact boolean")
    members = spark.createDataFrame([(c, i, i != 6 or c == 1) for c in (1, 2) for i in range(1, 7)], "campaign_id long, lead_id long, member boolean")
    sends = spark.createDataFrame([(10, 1, 1, "5511999990000", "SENT", 2, 1), (11, 2, 1, "5511999990000", "QUEUED", 1, 2), (12, 1, 6, "5511977776666", "FAILED", 3, 3)], "id long, campaign_id long, lead_id long, recipient string, status string, attempts long, created_at long")
    analyses = spark.createDataFrame([(1, 80)], "lead_id long, score long")
    got = {(r.campaign_id, r.lead_id): r for r in messaging.messaging_leads(members, leads, analyses, sends).collect()}
    codes = {k: r.code for k, r in got.items()}
    assert codes[1, 1] == "ALREADY_SENT" and codes[2, 1] == "ALREADY_QUEUED" and codes[1, 2] == "ALREADY_QUEUED" and codes[2, 2] == "ALREADY_SENT"
    assert [codes[1, i] for i in (3, 4, 5, 6)] == ["INVALID_PHONE", "NO_PHONE", "DO_NOT_CONTACT", None] and codes[2, 6] == "WRONG_CAMPAIGN"
    assert got[1, 1].score == 80 and got[1, 1].n_sends == 2 and (got[1, 6].latest_status, got[1, 6].attempts, got[1, 6].eligible) == ("FAILED", 3, True)


def test_keys_that_many_candidates_share_or_lack(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 AND id < 60 THEN concat('k', id) END AS phone", "CASE WHEN id % 2 = 0 THEN 'n' END AS name", "CASE WHEN id % 4 = 0 THEN 'c' END AS city")
    known = spark.createDataFrame([(9, "a", None, None), (7, "a", "n", None), (5, "k4", "n", "c"), (8, "k4", None, "c"), (6, "k7", "m", "c")], "id long, phone string, name string, city string")
    keys = {"phone": ["phone"], "name_city": ["name", "city"]}
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = dedup.existing_match(rows, known, keys)
        dealt = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(dealt) < 1500  # no key, and a missing one, takes most rows to one task
        for got in (out, dedup.existing_match(rows, known, keys, hot=100)):
            got = {r.id: (r.existing_id, r.reason) for r in got.collect()}
            assert got == {n: (7, "phone") if n % 3 == 0 else ({4: 5, 7: 6}[n], "phone") if n in (4, 7) else (5, "name_city") if n % 4 == 0 else (None, None) for n in range(3000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pairs_of_one_key_are_dealt_out(spark):
    left, right = spark.range(200).selectExpr("id AS a", "IF(id < 190, 1, id) AS k", "'x' AS j"), spark.range(50).selectExpr("id AS b", "IF(id < 45, 1, 195) AS k", "'x' AS j")
    out = dedup.every_pair(left, right, ["k", "j"], most=500)
    assert sorted((r.a, r.b) for r in out.collect()) == sorted([(a, b) for a in range(190) for b in range(45)] + [(195, b) for b in range(45, 50)])
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 190 * 45 / 2
    assert dedup.every_pair(left.limit(0), right, ["k", "j"]).count() == 0
