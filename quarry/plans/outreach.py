"""More of the reference's queries: the messaging read, batch duplicates, scan-state lookup, pool, lists and transitions.

Stand-ins as in ``crm``. Phones are written in the ways that the customers' keys and
balances choose, so that the normaliser has all its formats to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, funnel, messaging, state
from ..sources.tables import table
from .crm import SENDS, SQL_MEMBERS, memberships, pick, query, sql_in, sql_pick, stamp


def raw_phone() -> Column:
    n = F.lpad((F.floor(F.col("c_custkey") / 2) % 100000).cast("string"), 5, "0")
    local = F.concat(F.lit("119987"), n)
    forms = (F.concat(F.lit("(11) 9987"), F.substring(n, 1, 1), F.lit("-"), F.substring(n, 2, 4)), local, F.concat(F.lit("+55"), local), F.concat(F.lit("0055"), local), F.concat(F.lit("yes; +55 11 9987"), n), F.concat(F.lit("+1 415 555 "), F.substring(n, 2, 4)), n, F.concat(F.lit("5555"), local), F.lit("  "))
    out = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        out = F.when(F.col("c_custkey") % 10 == k, form).otherwise(out)
    return out


SQL_LEADS = """(SELECT c_custkey AS lead_id, CASE WHEN c_nationkey % 5 = 0 THEN 'US' WHEN c_nationkey % 5 = 1 THEN 'Brasil' END AS country, c_mktsegment = 'MACHINERY' AS do_not_contact,
  CASE c_custkey % 10 WHEN 0 THEN '(11) 9987' || n[1] || '-' || substring(n, 2, 4) WHEN 1 THEN '119987' || n WHEN 2 THEN '+55119987' || n WHEN 3 THEN '0055119987' || n WHEN 4 THEN 'yes; +55 11 9987' || n WHEN 5 THEN '+1 415 555 ' || substring(n, 2, 4)
    WHEN 6 THEN n WHEN 7 THEN '5555119987' || n WHEN 8 THEN '  ' END AS phone FROM (SELECT *, lpad(CAST((c_custkey // 2) % 100000 AS VARCHAR), 5, '0') AS n FROM customer))"""
NATIONAL = "^(1[1-9]|[2-9][0-9])[0-9]{8,9}$"
SQL_DIGITS = "list_transform(string_split(phone, ';'), lambda p: regexp_replace(regexp_replace(p, '[^0-9]', '', 'g'), '^(?:00)+(.)', '\\1'))"
SQL_RECIPIENT = f"""list_filter(list_transform({SQL_DIGITS}, lambda d: CASE WHEN coalesce(lower(country), 'br') NOT IN ('br', 'brasil', 'brazil') THEN CASE WHEN length(d) BETWEEN 8 AND 15 THEN d END
  WHEN length(d) BETWEEN 10 AND 11 THEN CASE WHEN regexp_matches(d, '{NATIONAL}') THEN '55' || d END WHEN starts_with(d, '55') AND NOT starts_with(d, '5555') AND regexp_matches(substring(d, 3), '{NATIONAL}') THEN d END), lambda d: d IS NOT NULL)[1]"""
SQL_RECIPIENTS = f"(SELECT *, {SQL_RECIPIENT} AS recipient FROM {SQL_LEADS})"
SQL_CAMPAIGN_SENDS = f"""(SELECT o_orderkey AS id, o_orderkey % 40 AS campaign_id, o_custkey AS lead_id, recipient, {sql_pick(SENDS, 'o_orderkey // 40')} AS status, o_orderkey % 6 + 1 AS attempts, o_orderdate AS created_at
  FROM orders JOIN {SQL_RECIPIENTS} ON lead_id = o_custkey WHERE o_orderkey % 3 = 0)"""
SQL_MESSAGING = f"""WITH s AS {SQL_CAMPAIGN_SENDS}, b AS (SELECT * FROM s WHERE status IN {sql_in(funnel.BLOCKING)}), m AS (SELECT DISTINCT o_orderkey % 40 AS campaign_id, o_custkey AS lead_id, o_orderkey % 7 <> 0 AS member FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 40, o_custkey ORDER BY o_orderkey) = 1),
  latest AS (SELECT campaign_id, lead_id, arg_max(id, (created_at, id)) AS id, arg_max(status, (created_at, id)) AS status, arg_max(attempts, (created_at, id)) AS attempts FROM s GROUP BY 1, 2), own AS (SELECT campaign_id, lead_id, arg_max(status, (created_at, id)) AS status FROM b GROUP BY 1, 2),
  r AS (SELECT m.campaign_id, m.lead_id, l.quality * 80 + l.toxic * 7 AS score, p.recipient, t.id AS latest_id, t.status AS latest_status, coalesce(t.attempts, 0) AS attempts, coalesce(n.n, 0) AS n_sends, m.member, p.do_not_contact, p.phone, own.status AS own_status,
    (SELECT arg_min(b.status, b.id) FROM b WHERE b.recipient = p.recipient AND b.campaign_id <> m.campaign_id) AS other
    FROM m JOIN {SQL_RECIPIENTS} p ON p.lead_id = m.lead_id LEFT JOIN labels l ON l.doc_id = m.lead_id LEFT JOIN latest t ON t.campaign_id = m.campaign_id AND t.lead_id = m.lead_id
    LEFT JOIN (SELECT lead_id, count(*) AS n FROM s GROUP BY 1) n ON n.lead_id = m.lead_id LEFT JOIN own ON own.campaign_id = m.campaign_id AND own.lead_id = m.lead_id),
  c AS (SELECT *, CASE WHEN NOT member THEN 'WRONG_CAMPAIGN' WHEN do_not_contact THEN 'DO_NOT_CONTACT' WHEN phone IS NULL OR trim(phone) = '' THEN 'NO_PHONE' WHEN recipient IS NULL THEN 'INVALID_PHONE' ELSE
    CASE coalesce(own_status, other) WHEN 'QUEUED' THEN 'ALREADY_QUEUED' WHEN 'SENDING' THEN 'ALREADY_SENDING' WHEN 'SENT' THEN 'ALREADY_SENT' WHEN 'DELIVERY_UNKNOWN' THEN 'DELIVERY_UNKNOWN' END END AS code FROM r)"""


def messaging_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    country = F.when(F.col("c_nationkey") % 5 == 0, "US").when(F.col("c_nationkey") % 5 == 1, "Brasil")
    leads = table(spark, d, "customer").select(F.col("c_custkey").alias("lead_id"), raw_phone().alias("phone"), country.alias("country"), (F.col("c_mktsegment") == "MACHINERY").alias("do_not_contact"))
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("campaign_id"), F.col("o_custkey").alias("lead_id"), F.col("o_orderdate").alias("created_at"))
    members = orders.groupBy("campaign_id", "lead_id").agg(F.min_by(F.col("o_orderkey") % 7 != 0, "o_orderkey").alias("member"))
    analyses = table(spark, d, "labels").select(F.col("doc_id").alias("lead_id"), (F.col("quality") * 80 + F.col("toxic") * 7).alias("score"))
    recipients = leads.select("lead_id", text.whatsapp_recipient(F.col("phone"), F.col("country")).alias("recipient"))
    sends = orders.where(F.col("o_orderkey") % 3 == 0).join(recipients, "lead_id").select(F.col("o_orderkey").alias("id"), "campaign_id", "lead_id", "recipient", pick(SENDS, F.floor(F.col("o_orderkey") / 40)).alias("status"), (F.col("o_orderkey") % 6 + 1).alias("attempts"), "created_at")
    return members, leads, analyses, sends


@query(f"{SQL_MESSAGING} SELECT campaign_id, lead_id, score, recipient, latest_id, latest_status, attempts, n_sends, code IS NULL AS eligible, code FROM c")
def messaging_page(spark, d):
    return messaging.messaging_leads(*messaging_tables(spark, d))


@query(f"{SQL_MESSAGING} SELECT campaign_id, count(*) FILTER (code IS NULL) AS eligible, count(*) FILTER (code IS NOT NULL) AS ineligible FROM c GROUP BY 1")
def messaging_counts(spark, d):
    return messaging.eligibility_counts(messaging.messaging_leads(*messaging_tables(spark, d)))


@query(f"SELECT lead_id, recipient FROM {SQL_RECIPIENTS}")
def whatsapp_recipients(spark, d):
    return messaging_tables(spark, d)[1].select("lead_id", text.whatsapp_recipient(F.col("phone"), F.col("country")).alias("recipient"))


def batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as the candidates of a run, suppliers as the pool, nations as leads."""
    n = F.col("c_custkey")
    word = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    rows = table(spark, d, "customer").select(
        n.alias("rank"), word("node/", n % 1100).alias("source"), word("openstreetmap_node/", n % 1100).alias("global_source"),
        F.when(n % 3 != 0, word("55", n * 7 % 900)).alias("phone"), F.when(n % 4 != 1, word("u", n * 13 % 800)).alias("instagram"),
    )
    s = F.col("s_suppkey")
    pool = table(spark, d, "supplier").select(word("node/", s * 31).alias("source"), word("55", s * 3).alias("phone"), F.when(s % 2 == 0, word("u", s * 5)).alias("instagram"))
    k = F.col("n_nationkey")
    leads = table(spark, d, "nation").select(word("55", k * 11).alias("phone"), F.when(k % 3 == 0, F.lit(" ")).otherwise(word("u", k * 17)).alias("instagram"), word("openstreetmap_node/", k * 37 + 2).alias("global_source"))
    return rows, pool, leads


SQL_BATCH = """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY c_custkey) AS pos, c_custkey AS rank, 'node/' || c_custkey % 1100 AS source, 'openstreetmap_node/' || c_custkey % 1100 AS global_source, CASE WHEN c_custkey % 3 <> 0 THEN '55' || c_custkey * 7 % 900 END AS phone, CASE WHEN c_custkey % 4 <> 1 THEN 'u' || c_custkey * 13 % 800 END AS instagram FROM customer),
  f AS (SELECT *, source IN (SELECT 'node/' || s_suppkey * 31 FROM supplier) AS pool_source, coalesce(phone IN (SELECT '55' || s_suppkey * 3 FROM supplier), false) AS pool_phone, coalesce(instagram IN (SELECT 'u' || s_suppkey * 5 FROM supplier WHERE s_suppkey % 2 = 0), false) AS pool_instagram,
    coalesce(phone IN (SELECT '55' || n_nationkey * 11 FROM nation), false) AS lead_phone, coalesce(instagram IN (SELECT 'u' || n_nationkey * 17 FROM nation WHERE n_nationkey % 3 <> 0), false) AS lead_instagram, global_source IN (SELECT 'openstreetmap_node/' || (n_nationkey * 37 + 2) FROM nation) AS lead_source FROM r),
  w AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS rank, '' AS kind, CAST([] AS VARCHAR[]) AS seen UNION ALL SELECT n.pos, n.rank, n.kind, CASE WHEN n.kind = 'NONE' THEN list_concat(n.seen, list_filter([n.source, n.phone, n.instagram], lambda x: x IS NOT NULL)) ELSE n.seen END FROM
    (SELECT f.*, w.seen, CASE WHEN list_contains(w.seen, f.source) OR pool_source THEN 'SOURCE' WHEN lead_phone THEN 'GLOBAL' WHEN coalesce(list_contains(w.seen, f.phone), false) OR pool_phone THEN 'PHONE' WHEN lead_instagram THEN 'GLOBAL' WHEN coalesce(list_contains(w.seen, f.instagram), false) OR pool_instagram THEN 'INSTAGRAM' WHEN lead_source THEN 'GLOBAL' ELSE 'NONE' END AS kind
     FROM w JOIN f ON f.pos = w.pos + 1) n)"""


@query(f"{SQL_BATCH} SELECT rank, kind FROM w WHERE pos > 0")
def batch_duplicates(spark, d):
    return dedup.batch_duplicates(*batch(spark, d)).select("rank", "kind")


@query(f"{SQL_BATCH} SELECT count(*) FILTER (kind = 'PHONE') AS duplicate_phone, count(*) FILTER (kind = 'INSTAGRAM') AS duplicate_instagram, count(*) FILTER (kind IN ('SOURCE', 'GLOBAL')) AS duplicate_source, count(*) FILTER (kind <> 'NONE') AS duplicates FROM w WHERE pos > 0")
def duplicate_counters(spark, d):
    return dedup.duplicate_counters(dedup.batch_duplicates(*batch(spark, d)))


@query(
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 AS region_id, l_partkey AS osm_id, l_shipdate AS stamp FROM lineitem), s AS (SELECT o_custkey % 5 AS region_id, o_custkey AS osm_id, arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS known, arg_max({sql_pick(('QUALIFIED', 'NO_PHONE', 'NO_INSTAGRAM'), 'o_orderkey')}, (o_orderdate, o_orderkey)) AS outcome,
    arg_max(CASE WHEN o_orderkey % 7 = 0 THEN 'v1' ELSE 'v2' END, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY 1, 2)
  SELECT l_orderkey, l_linenumber, outcome, CASE WHEN outcome IS NULL THEN false WHEN outcome = 'QUALIFIED' THEN true WHEN stamp <> known THEN false WHEN version <> 'v2' THEN false WHEN known + INTERVAL 30 DAYS < TIMESTAMP '1995-01-01' THEN false ELSE true END AS skipped FROM c LEFT JOIN s USING (region_id, osm_id)"""
)
def scan_state_lookup(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 5).alias("region_id"), F.col("l_partkey").alias("osm_id"), F.col("l_shipdate").cast("timestamp").alias("stamp"))
    o = table(spark, d, "orders")
    known = o.groupBy((F.col("o_custkey") % 5).alias("region_id"), F.col("o_custkey").alias("osm_id")).agg(
        F.max_by(F.struct(F.col("o_orderdate").cast("timestamp").alias("known"), pick(("QUALIFIED", "NO_PHONE", "NO_INSTAGRAM"), F.col("o_orderkey")).alias("outcome"), F.when(F.col("o_orderkey") % 7 == 0, "v1").otherwise("v2").alias("version")), F.struct("o_orderdate", "o_orderkey")).alias("s")
    ).select("region_id", "osm_id", "s.*")
    looked_up = funnel.with_scan_state(rows, known.withColumn("retry_after", F.col("known") + F.expr("INTERVAL 30 DAYS")), ["region_id", "osm_id"], "v2", F.lit("1995-01-01").cast("timestamp"))
    return looked_up.select("l_orderkey", "l_linenumber", "outcome", "skipped")


@query("SELECT c_nationkey AS owner_id, count(DISTINCT o_orderkey) FILTER (o_orderstatus IN ('O', 'P')) AS active FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def active_campaigns(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_nationkey").alias("owner_id")).agg(F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("active"))


@query("SELECT o_orderkey AS run_id, o_custkey AS target_id FROM orders WHERE o_custkey IN (3, 7, 11) AND o_orderstatus IN ('O', 'P')")
def active_runs(spark, d):
    o = table(spark, d, "orders").where(F.col("o_custkey").isin(3, 7, 11) & F.col("o_orderstatus").isin("O", "P"))
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("target_id"))


@query("SELECT o_orderkey AS id, o_custkey AS lead_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def newest_first(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lead_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("place"))


@query(f"""SELECT c_custkey AS place_id, s_suppkey AS target_id FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_mktsegment = {sql_pick(('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD'), 's_suppkey')}""")
def places_of_targets(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target_id"), F.col("s_nationkey").alias("region"), pick(("BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"), F.col("s_suppkey")).alias("niche"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("niche"))
    return dedup.every_pair(c, s, ["region", "niche"]).select("place_id", "target_id")


@query("""SELECT c_custkey AS id, coalesce(t.target, -1) AS target_id FROM customer LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS target FROM supplier GROUP BY 1) t ON c_nationkey = s_nationkey""")
def backfilled_targets(spark, d):
    """An update from a join: rows without a partner keep what they have."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("region"), F.lit(-1).cast("long").alias("target_id"))
    values = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("region")).agg(F.min("s_suppkey").alias("target_id"))
    return state.update_from(rows, values, ["region"], ["target_id"]).select("id", "target_id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN strftime(TIMESTAMP '1998-01-01', '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS last_success_at, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE substring(o_orderpriority, 1, 5) END AS last_error FROM orders""")
def target_outcomes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("last_success_at"), F.lit("before").alias("last_error"), (F.col("o_orderstatus") == "F").alias("succeeded"), F.substring("o_orderpriority", 1, 5).alias("error"))
    done = state.run_outcome(o, F.col("succeeded"), F.col("error"), F.lit("1998-01-01").cast("timestamp"))
    return done.select("id", stamp("last_success_at").alias("last_success_at"), "last_error")


@query(f"SELECT owner_id, lead_id, status, rank AS place FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY lead_id, status) AS rank FROM (SELECT DISTINCT owner_id, lead_id, status FROM {SQL_MEMBERS})) WHERE rank <= 30")
def first_page_per_owner(spark, d):
    from pyspark.sql import Window

    rows = memberships(spark, d).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("owner_id").orderBy("lead_id", "status")).cast("long")).where("place <= 30")
