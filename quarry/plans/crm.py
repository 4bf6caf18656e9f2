"""The reference's queries, bound to the tables at hand, each beside the SQL that says the same.

Stand-ins: leads are customers, owners their nations, campaigns suppliers, sends
orders, lead events ``events``, tags the keys of ``events.props``, official texts and
sites ``documents`` and ``pages``. What a stand-in lacks is derived from its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, html, scoring, text
from ..operators import dedup, funnel, latest, niches, state
from ..sources import geojson
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The instant that stands for "now", so that results don't depend on the clock.
NOW = "1998-01-01 00:00:00"
STATUSES = ("NEW", "ANALYZING", "ERROR", "ANALYZED", "MESSAGE_READY", "APPROVED", "SENT", "REPLIED", "INTERESTED", "SCHEDULED", "CONVERTED", "DO_NOT_CONTACT")
SENDS = ("QUEUED", "SENDING", "SENT", "DELIVERY_UNKNOWN", "FAILED", "SKIPPED")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(({n}) % {len(values)} + 1 AS INTEGER)]"


def sql_in(values) -> str:
    return f"({', '.join(repr(v) for v in values)})"


def memberships(spark: SparkSession, d: str) -> DataFrame:
    """A row per order: the customer is the lead, the nation the owner."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("owner_id"), F.col("o_custkey").alias("lead_id"), pick(STATUSES, F.col("o_orderkey")).alias("status"))


SQL_MEMBERS = f"(SELECT c_nationkey AS owner_id, o_custkey AS lead_id, {sql_pick(STATUSES, 'o_orderkey')} AS status FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"SELECT owner_id, count(*) AS total, {', '.join(f'count(*) FILTER (status IN {sql_in(v)}) AS {k}' for k, v in funnel.DASHBOARD.items())} FROM {SQL_MEMBERS} GROUP BY owner_id")
def status_funnel(spark, d):
    return funnel.dashboard(memberships(spark, d), ["owner_id"])


@query(f"SELECT owner_id, status, count(*) AS leads FROM {SQL_MEMBERS} GROUP BY ALL")
def status_counts(spark, d):
    return funnel.status_counts(memberships(spark, d), ["owner_id"])


def campaign_members(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (supplier, customer) pairs, with what the counters need of the customer."""
    bridge = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    bridge = bridge.select(F.col("l_suppkey").alias("campaign_id"), F.col("o_custkey").alias("lead_id")).distinct()
    leads = table(spark, d, "customer").select("c_custkey", pick(STATUSES, F.col("c_custkey")).alias("status"), (F.col("c_acctbal") > 0).alias("analyzed"), (F.col("c_mktsegment") == "MACHINERY").alias("do_not_contact"))
    return bridge.join(leads, F.col("lead_id") == F.col("c_custkey")).drop("c_custkey")


SQL_CAMPAIGN = f"""(SELECT campaign_id, {sql_pick(STATUSES, 'c_custkey')} AS status, c_acctbal > 0 AS analyzed, c_mktsegment = 'MACHINERY' AS do_not_contact, lead_id
  FROM (SELECT DISTINCT l_suppkey AS campaign_id, o_custkey AS lead_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN customer ON lead_id = c_custkey)"""
SQL_COUNTERS = f"SELECT campaign_id, count(*) AS discovered_count, count(*) FILTER (analyzed) AS analyzed_count, {', '.join(f'count(*) FILTER (status IN {sql_in(v)}) AS {k}' for k, v in funnel.COUNTERS.items())}, count(*) FILTER (do_not_contact) AS blocked_count FROM {SQL_CAMPAIGN} GROUP BY campaign_id"


@query(SQL_COUNTERS)
def campaign_counters(spark, d):
    return funnel.campaign_counters(campaign_members(spark, d))


@query(
    f"""SELECT campaign_id, CASE WHEN errors > 0 OR discovered_count < requested THEN 'PARTIAL' WHEN analyzed_count >= requested AND message_count >= requested THEN 'COMPLETED' ELSE 'PARTIAL' END AS outcome,
  CASE WHEN campaign_id % 3 = 0 THEN 'ANALYSIS' WHEN campaign_id % 3 = 1 THEN CASE WHEN discovered_count < requested THEN 'PARTIAL' ELSE 'ANALYSIS' END ELSE 'CAMPAIGN_ALREADY_PROCESSING' END AS retry,
  CAST(floor(100 * analyzed_count / discovered_count + 0.5) AS BIGINT) AS percent
  FROM (SELECT *, campaign_id % 40 AS requested, CASE WHEN campaign_id % 2 = 0 THEN 0 ELSE error_count END AS errors FROM ({SQL_COUNTERS}))"""
)
def campaign_outcomes(spark, d):
    c = funnel.campaign_counters(campaign_members(spark, d)).withColumns({"requested": F.col("campaign_id") % 40, "errors": F.when(F.col("campaign_id") % 2 == 0, 0).otherwise(F.col("error_count"))})
    status = pick(("FAILED", "PARTIAL", "ANALYZING"), F.col("campaign_id"))
    return c.select(
        "campaign_id", scoring.campaign_outcome(F.lit("ANALYZING"), F.col("discovered_count"), F.col("requested"), F.col("errors"), F.col("analyzed_count"), F.col("message_count")).alias("outcome"),
        scoring.retry_plan(status, F.col("discovered_count"), F.col("requested")).alias("retry"), scoring.progress_percent(F.col("analyzed_count"), F.col("discovered_count"), status).alias("percent"),
    )


@query(
    """SELECT c_custkey AS lead_id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), '12') OR contains(lower(c_name), '7'))
  AND EXISTS (SELECT 1 FROM orders JOIN nation ON c_nationkey = n_nationkey WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND n_regionkey IN (1, 2))"""
)
def owned_leads_search(spark, d):
    owned = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    mine = table(spark, d, "nation").where("n_regionkey IN (1, 2)").select("n_nationkey")
    name = F.lower("c_name")
    leads = table(spark, d, "customer").where((F.col("c_mktsegment") == "BUILDING") & (name.contains("12") | name.contains("7")))
    leads = leads.join(mine, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").join(owned, F.col("c_custkey") == F.col("k"), "left_semi")
    return leads.select(F.col("c_custkey").alias("lead_id"), F.col("c_name").alias("name"))


@query("SELECT d.doc_id, quality, toxic, coalesce(nullif(trim(source), ''), 'unknown') AS business_type, l.doc_id IS NOT NULL AS analyzed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lead_left_analysis(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("k"), "quality", "toxic")
    return table(spark, d, "documents").select("doc_id", "source").join(labels, F.col("doc_id") == F.col("k"), "left").select("doc_id", "quality", "toxic", text.or_unknown(F.col("source")).alias("business_type"), F.col("k").isNotNull().alias("analyzed"))


def sends(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    created = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lead_id"), pick(SENDS, F.col("o_orderkey")).alias("status"), created.alias("created_at"),
        F.when(F.col("o_orderstatus") != "P", created + F.expr("INTERVAL 3 DAYS")).alias("next_attempt_at"), created.alias("last_attempt_at"), (F.col("o_orderkey") % 6 + 1).alias("attempts"),
    )


SQL_SENDS = f"""(SELECT o_orderkey AS id, o_custkey AS lead_id, {sql_pick(SENDS, 'o_orderkey')} AS status, o_orderdate AS created_at,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 3 DAYS END AS next_attempt_at, o_orderdate AS last_attempt_at, o_orderkey % 6 + 1 AS attempts FROM orders)"""
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {1}"


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"SELECT lead_id, id, status, {STAMP.format('created_at', 'created_at')} FROM {SQL_SENDS} QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) = 1")
def latest_send_per_lead(spark, d):
    return latest.latest_by(sends(spark, d).select("lead_id", "id", "status", "created_at"), "lead_id", ["created_at", "id"]).withColumn("created_at", stamp("created_at"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1")
def latest_turn_per_conversation(spark, d):
    return latest.latest_by(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", ["turn", "role", "text"])


@query(
    f"""WITH s AS {SQL_SENDS}, own AS (SELECT lead_id, arg_max(status, (created_at, id)) AS status FROM s WHERE status IN {sql_in(funnel.BLOCKING)} GROUP BY lead_id)
  SELECT c_custkey AS lead_id, CASE WHEN c_nationkey IS NULL THEN 'WRONG_CAMPAIGN' WHEN c_mktsegment = 'MACHINERY' THEN 'DO_NOT_CONTACT' WHEN c_acctbal < 0 THEN 'NO_PHONE' WHEN c_acctbal < 500 THEN 'INVALID_PHONE'
    WHEN own.status = 'QUEUED' THEN 'ALREADY_QUEUED' WHEN own.status = 'SENDING' THEN 'ALREADY_SENDING' WHEN own.status = 'SENT' THEN 'ALREADY_SENT' WHEN own.status = 'DELIVERY_UNKNOWN' THEN 'DELIVERY_UNKNOWN' END AS code
  FROM customer LEFT JOIN own ON own.lead_id = c_custkey"""
)
def messaging_leads(spark, d):
    blocking = sends(spark, d).where(F.col("status").isin(*funnel.BLOCKING)).groupBy("lead_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("own"))
    c = table(spark, d, "customer").withColumn("phone", F.when(F.col("c_acctbal") >= 500, F.format_string("11%09d", "c_custkey")).when(F.col("c_acctbal") >= 0, "123"))
    recipient = text.whatsapp_recipient(F.col("phone"), F.lit(None).cast("string"))
    joined = c.join(blocking, F.col("lead_id") == F.col("c_custkey"), "left")
    code = funnel.eligibility(F.col("c_nationkey").isNotNull(), F.col("c_mktsegment") == "MACHINERY", F.col("phone"), recipient, F.col("own"), F.lit(None).cast("string"))
    return joined.select(F.col("c_custkey").alias("lead_id"), code.alias("code"))


@query(
    """SELECT c_nationkey AS target_id, count(*) AS available_new FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND (o_custkey = c_custkey OR CAST(floor(o_totalprice) AS BIGINT) = CAST(floor(c_acctbal) AS BIGINT)
  OR 'order_' || (o_orderkey % 1000) = 'order_' || c_custkey)) GROUP BY c_nationkey"""
)
def available_new(spark, d):
    known = table(spark, d, "orders").where("o_orderstatus = 'P'")
    keys = [(F.col("c_custkey"), F.col("o_custkey")), (F.floor("c_acctbal"), F.floor("o_totalprice")), (text.source_key(F.lit("order"), F.col("c_custkey").cast("string")), text.source_key(F.lit("order"), (F.col("o_orderkey") % 1000).cast("string")))]
    return dedup.without_existing(table(spark, d, "customer"), known, keys).groupBy(F.col("c_nationkey").alias("target_id")).agg(F.count("*").alias("available_new"))


@query("SELECT n_nationkey AS region_id, n_name AS name, coalesce(n, 0) AS place_count FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING' GROUP BY 1) ON c_nationkey = n_nationkey")
def place_count_zero_fill(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("name"))
    return funnel.zero_filled(nations, table(spark, d, "customer").where("c_acctbal > 9000 AND c_mktsegment = 'BUILDING'"), "region_id", "c_nationkey", "place_count")


@query("SELECT s_suppkey AS target_id, coalesce(n, 0) AS qualified_count, CASE WHEN coalesce(n, 0) > 0 THEN 'READY' ELSE 'EMPTY' END AS pool_status FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 GROUP BY 1) ON l_suppkey = s_suppkey")
def target_pool_status(spark, d):
    members = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49")
    out = funnel.zero_filled(table(spark, d, "supplier").select(F.col("s_suppkey").alias("target_id")), members, "target_id", "l_suppkey", "qualified_count")
    return out.withColumn("pool_status", F.when(F.col("qualified_count") > 0, "READY").otherwise("EMPTY"))


@query("SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1")
def distinct_on_first(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority", "o_orderdate")
    return dedup.first_of_each(rows, ["o_custkey", "o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query(
    """WITH e AS (SELECT o_orderkey AS id, 'src_' || o_orderkey AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || (o_orderkey % 500) END AS instagram, CASE WHEN o_orderkey % 5 = 0 THEN 's' || (o_orderkey % 700) || '.example' END AS website,
    CAST(o_custkey AS VARCHAR) AS phone, o_orderpriority AS city, o_orderstatus AS name FROM orders WHERE o_orderstatus <> 'O'),
  a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'src_' || l_orderkey END AS source_id, CASE WHEN l_linenumber IN (2, 3) THEN 'u' || (l_partkey % 900) END AS instagram, CASE WHEN l_linenumber IN (3, 4) THEN 's' || (l_suppkey % 900) || '.example' END AS website,
    CASE WHEN l_linenumber < 6 THEN CAST(l_suppkey AS VARCHAR) END AS phone, l_returnflag AS name, CASE WHEN l_linenumber > 4 THEN '1-URGENT' END AS city FROM lineitem),
  s AS (SELECT source_id, min(id) AS id FROM e GROUP BY 1), i AS (SELECT instagram, min(id) AS id FROM e GROUP BY 1), w AS (SELECT website, min(id) AS id FROM e GROUP BY 1), p AS (SELECT phone, min(id) AS id FROM e GROUP BY 1), n AS (SELECT name, city, min(id) AS id FROM e GROUP BY 1, 2)
  SELECT l_orderkey, l_linenumber, coalesce(s.id, i.id, w.id, p.id, n.id) AS existing_id, CASE WHEN s.id IS NOT NULL THEN 'source_id' WHEN i.id IS NOT NULL THEN 'instagram' WHEN w.id IS NOT NULL THEN 'website' WHEN p.id IS NOT NULL THEN 'phone' WHEN n.id IS NOT NULL THEN 'name_city' END AS reason
  FROM a LEFT JOIN s ON a.source_id = s.source_id LEFT JOIN i ON a.instagram = i.instagram LEFT JOIN w ON a.website = w.website LEFT JOIN p ON a.phone = p.phone LEFT JOIN n ON a.name = n.name AND a.city = n.city"""
)
def dedup_cascade(spark, d):
    """The first of all five keys by which a candidate is known: source, Instagram, website, phone, name and city."""
    o, k = table(spark, d, "orders").where("o_orderstatus <> 'O'"), F.col("o_orderkey")
    known = o.select(
        k.alias("id"), text.source_key(F.lit(None).cast("string"), k.cast("string")).alias("source_id"), F.when(k % 3 == 0, text.instagram_handle(F.concat(F.lit("https://instagram.com/U"), (k % 500).cast("string"), F.lit("/")))).alias("instagram"),
        F.when(k % 5 == 0, text.website_host(F.concat(F.lit("http://www.S"), (k % 700).cast("string"), F.lit(".example/x")))).alias("website"), F.col("o_custkey").cast("string").alias("phone"), F.col("o_orderpriority").alias("city"), F.col("o_orderstatus").alias("name"),
    )
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", line, F.when(line == 1, text.source_key(F.lit(None).cast("string"), F.col("l_orderkey").cast("string"))).alias("source_id"), F.when(line.isin(2, 3), text.instagram_handle(F.concat(F.lit("@u"), (F.col("l_partkey") % 900).cast("string")))).alias("instagram"),
        F.when(line.isin(3, 4), text.website_host(F.concat(F.lit("s"), (F.col("l_suppkey") % 900).cast("string"), F.lit(".EXAMPLE")))).alias("website"), F.when(line < 6, F.col("l_suppkey").cast("string")).alias("phone"), F.col("l_returnflag").alias("name"), F.when(line > 4, "1-URGENT").alias("city"),
    )
    keys = {"source_id": ["source_id"], "instagram": ["instagram"], "website": ["website"], "phone": ["phone"], "name_city": ["name", "city"]}
    return dedup.existing_match(rows, known, keys).select("l_orderkey", "l_linenumber", "existing_id", "reason")


@query(
    """WITH o AS (SELECT o_orderkey AS rank, o_custkey AS phone, strftime(o_orderdate, '%Y-%m-%d') AS instagram, o_orderstatus <> 'P' AS ok FROM orders),
  scan AS (SELECT list_reduce(list({'r': rank, 'p': phone, 'i': instagram} ORDER BY rank) FILTER (ok), lambda a, x: CASE WHEN list_contains(a.p, x.p) OR list_contains(a.i, x.i) THEN a
    ELSE {'r': list_append(a.r, x.r), 'p': list_append(a.p, x.p), 'i': list_append(a.i, x.i)} END, {'r': []::BIGINT[], 'p': []::BIGINT[], 'i': []::VARCHAR[]}).r AS taken FROM o),
  a AS (SELECT rank, phone, instagram, row_number() OVER (ORDER BY rank) AS n FROM o JOIN (SELECT unnest(taken) AS rank FROM scan) USING (rank))
  SELECT rank, o.phone, o.instagram, CASE WHEN a.n <= 50 THEN 'QUALIFIED' WHEN a.n IS NOT NULL THEN 'OVER_QUOTA' WHEN ok OR least(p.first, i.first) < rank THEN 'DUPLICATE' ELSE 'INELIGIBLE' END AS outcome
  FROM o LEFT JOIN a USING (rank) LEFT JOIN (SELECT phone, min(rank) AS first FROM a GROUP BY 1) p ON p.phone = o.phone LEFT JOIN (SELECT instagram, min(rank) AS first FROM a GROUP BY 1) i ON i.instagram = o.instagram"""
)
def greedy_dedup_quota(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("rank"), F.col("o_custkey").alias("phone"), F.col("o_orderdate").cast("date").cast("string").alias("instagram"), (F.col("o_orderstatus") != "P").alias("on_whatsapp"))
    return dedup.accept_quota(rows, "rank", ["phone", "instagram"], 50, F.col("on_whatsapp")).select("rank", "phone", "instagram", "outcome")


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderdate AS first_at FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT o_orderkey AS id, o_totalprice + 1 AS price, o_orderdate + INTERVAL 1 DAY AS first_at FROM orders WHERE o_orderpriority <> '5-LOW')
  SELECT coalesce(o.id, n.id) AS id, coalesce(n.price, o.price) AS price, strftime(coalesce(o.first_at, n.first_at), '%Y-%m-%d') AS first_at FROM o FULL JOIN n ON o.id = n.id"""
)
def upsert_keep_first(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("first_at"), "o_orderstatus", "o_orderpriority")
    old = o.where("o_orderstatus <> 'P'").select("id", "price", "first_at")
    new = o.where("o_orderpriority <> '5-LOW'").select("id", (F.col("price") + 1).alias("price"), (F.col("first_at") + F.expr("INTERVAL 1 DAY")).alias("first_at"))
    return state.upsert(old, new, ["id"], keep_first=("first_at",)).withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd"))


@query("SELECT o_custkey AS id, 'old' AS origin FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def backfill_do_nothing(spark, d):
    old = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct().withColumn("origin", F.lit("old"))
    return state.insert_missing(old, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("new").alias("origin")), ["id"])


@query(f"SELECT id, lead_id, {STAMP.format('next_attempt_at', 'next_attempt_at')} FROM {SQL_SENDS} WHERE status = 'QUEUED' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '1995-01-01') ORDER BY next_attempt_at NULLS FIRST, id LIMIT 30")
def due_queue_page(spark, d):
    return latest.due_first(sends(spark, d), F.lit("1995-01-01").cast("timestamp"), 30).select("id", "lead_id", stamp("next_attempt_at").alias("next_attempt_at"))


@query(f"SELECT id, CASE WHEN status = 'SENDING' AND last_attempt_at <= TIMESTAMP '1995-06-01' - INTERVAL 10 MINUTES THEN 'DELIVERY_UNKNOWN' ELSE status END AS status FROM {SQL_SENDS}")
def stuck_sweep(spark, d):
    return state.sweep_stuck(sends(spark, d), F.lit("1995-06-01").cast("timestamp")).select("id", "status")


CODES = ("INVALID_TEXT", "WHATSAPP_NOT_CONNECTED", "WHATSAPP_READ_TIMEOUT", "PROVIDER_NOT_FOUND", "WHATSAPP_AUTH_MISMATCH", "SOMETHING_ELSE", "TEXT_TOO_LONG")


@query(
    f"""WITH s AS (SELECT *, {sql_pick(CODES, 'id')} AS code FROM {SQL_SENDS}), k AS (SELECT *, CASE WHEN code IN {sql_in(scoring.TERMINAL_CODES)} THEN 'TERMINAL' WHEN code IN {sql_in(scoring.TRANSIENT_CODES)} THEN 'TRANSIENT' WHEN code = 'PROVIDER_NOT_FOUND' THEN code ELSE 'AMBIGUOUS' END AS category FROM s),
  t AS (SELECT *, CASE WHEN category IN ('TERMINAL', 'PROVIDER_NOT_FOUND') OR (category = 'TRANSIENT' AND attempts >= 5) THEN 'FAILED' WHEN category = 'TRANSIENT' THEN 'QUEUED' ELSE 'DELIVERY_UNKNOWN' END AS next_status FROM k)
  SELECT id, category, next_status AS status, CASE WHEN next_status = 'QUEUED' THEN strftime(TIMESTAMP '{NOW}' + to_minutes(CAST(1 << attempts AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS next_attempt_at FROM t"""
)
def retry_schedule(spark, d):
    code = pick(CODES, F.col("id"))
    return state.fail(sends(spark, d), code, now()).select("id", scoring.failure_category(code).alias("category"), "status", stamp("next_attempt_at").alias("next_attempt_at"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY' AND trim(c_name) <> '' ORDER BY c_name, c_custkey LIMIT 300 OFFSET 100")
def pool_page(spark, d):
    rows = table(spark, d, "customer").where((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "MACHINERY") & text.present(F.col("c_name")).isNotNull())
    return latest.page(rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), [F.col("name"), F.col("id")], 100, latest.pool_page_size(30))


TAG_SQL = "MAP_FROM_ENTRIES([(k, v)])"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Events as places: their type says which tags they have."""
    k = F.col("event_type")
    pairs = F.map_filter(
        F.create_map(F.lit("phone"), F.when(k.isin("click", "purchase"), "11999999999"), F.lit("contact:instagram"), F.when(k == "purchase", "studio"), F.lit("website"), F.when(k.isin("click", "view", "signup"), "a.com"), F.lit("facebook"), F.when(k == "view", "x"), F.lit("name"), F.lit("y")), lambda _, v: v.isNotNull()
    )
    return table(spark, d, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), "user_id", pairs.alias("tags"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS tier, event_type <> 'error' AS commercial FROM events")
def tier_sort(spark, d):
    t = tagged(spark, d)
    rows = t.select("event_id", niches.priority_tier(F.col("tags")).alias("tier"), niches.commercial_or_contact(F.col("tags")).alias("commercial"))
    return rows.orderBy("tier", "event_id")


@query(
    f"""SELECT o_orderkey AS id, CASE WHEN outcome IS NULL THEN false WHEN outcome = 'QUALIFIED' THEN true WHEN current_at <> o_orderdate THEN false WHEN version <> 'v2' THEN false WHEN o_orderdate + INTERVAL 30 DAYS < TIMESTAMP '1995-01-01' THEN false ELSE true END AS skipped
  FROM (SELECT *, {sql_pick(('QUALIFIED', 'NO_PHONE', 'NO_INSTAGRAM'), 'o_custkey')} AS raw, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE {sql_pick(('QUALIFIED', 'NO_PHONE', 'NO_INSTAGRAM'), 'o_custkey')} END AS outcome,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS current_at, CASE WHEN o_custkey % 7 = 0 THEN 'v1' ELSE 'v2' END AS version FROM orders)"""
)
def scan_skip(spark, d):
    o = table(spark, d, "orders").withColumn("known", F.col("o_orderdate").cast("timestamp"))
    outcome = F.when(F.col("o_orderpriority") != "5-LOW", pick(("QUALIFIED", "NO_PHONE", "NO_INSTAGRAM"), F.col("o_custkey")))
    current = F.when(F.col("o_orderstatus") == "F", F.col("known") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("known"))
    skipped = funnel.skip_scan(outcome, F.col("known"), current, F.when(F.col("o_custkey") % 7 == 0, "v1").otherwise("v2"), "v2", F.col("known") + F.expr("INTERVAL 30 DAYS"), F.lit("1995-01-01").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("id"), skipped.alias("skipped"))


@query(
    f"""WITH s AS (SELECT *, CASE WHEN event_type = 'error' THEN 'NOT_COMMERCIAL' WHEN value < 5 THEN 'NOT_POTENTIAL' WHEN user_id % 10 = 0 THEN 'SCAN_SKIPPED' WHEN event_type NOT IN ('click', 'purchase', 'view', 'signup') THEN 'NO_OFFICIAL_CONTACT_CHANNEL'
    WHEN user_id % 11 = 0 THEN 'TECHNICAL_FAILURE' WHEN value < 10 THEN 'NICHE_NOT_CONFIRMED' WHEN event_type = 'click' THEN 'NO_INSTAGRAM' WHEN event_type IN ('view', 'signup') THEN 'NO_INSTAGRAM' WHEN user_id % 5 = 0 THEN 'DUPLICATE' WHEN user_id % 7 = 0 THEN 'NOT_ON_WHATSAPP' ELSE 'QUALIFIED' END AS stage FROM events),
  f AS (SELECT CAST(ts AS DATE) AS day, count(*) AS objects_read, {', '.join(f"count(*) FILTER (stage = '{x}') AS {x.lower()}" for x in funnel.STAGES)}, count(*) FILTER (stage = 'QUALIFIED') AS qualified_saved FROM s GROUP BY 1)
  SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day), CASE WHEN qualified_saved >= 50 THEN 'SUCCESS' WHEN technical_failure > 0 OR qualified_saved > 0 THEN 'PARTIAL' ELSE 'EXHAUSTED' END AS status, qualified_saved < 50 AND technical_failure = 0 AS exhausted FROM f"""
)
def sync_funnel(spark, d):
    t, tags, user = tagged(spark, d), F.col("tags"), F.col("user_id")
    where = funnel.stage(
        niches.commercial_or_contact(tags), F.col("value") >= 5, user % 10 != 0, niches.has_contact_channel(tags), user % 11 != 0, F.col("value") >= 10,
        niches.any_tag(tags, niches.INSTAGRAM), niches.any_tag(tags, niches.PHONES), user % 5 != 0, user % 7 != 0,
    )
    f = funnel.funnel(t.withColumn("stage", where).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"])
    saved, technical = F.col("qualified_saved"), F.col("technical_failure")
    return f.withColumns({"status": scoring.run_status(saved, F.lit(50), technical), "exhausted": scoring.run_exhausted(saved, F.lit(50), technical)})


PHRASES = ("de la", "the and", "und der", "cc by", "mit license", "of the")


@query(f"SELECT doc_id, {', '.join(f'''contains(' ' || t || ' ', ' {p} ') AS p{n}''' for n, p in enumerate(PHRASES))} FROM (SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^\\p{{L}}0-9]+', ' ', 'g')) AS t FROM documents)")
def name_phrase_match(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.normalize_phrase(F.col("text")).alias("t"))
    return t.select("doc_id", *(text.has_phrase(F.col("t"), F.lit(p)).alias(f"p{n}") for n, p in enumerate(PHRASES)))


@query(
    """WITH s AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 0 WHEN d.doc_id % 3 = 1 THEN 30 ELSE 15 END + CASE d.doc_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 14 WHEN 2 THEN 8 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN lang = 'en' THEN 5 ELSE 0 END
    + CASE WHEN d.doc_id % 5 = 0 THEN 10 ELSE 0 END AS raw, CASE WHEN quality IS NOT NULL THEN quality * 80 + toxic * 7 END AS ai FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  c AS (SELECT doc_id, ai, greatest(5, least(100, raw)) AS signal FROM s) SELECT doc_id, CAST(CASE WHEN ai IS NULL THEN signal ELSE greatest(0, least(100, floor((65 * ai + 35 * signal) / 100 + 0.5))) END AS INTEGER) AS score FROM c"""
)
def opportunity_score(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("k"), (F.col("quality") * 80 + F.col("toxic") * 7).alias("ai"))
    j = table(spark, d, "documents").select("doc_id", "source", "lang").join(labels, F.col("doc_id") == F.col("k"), "left")
    doc = F.col("doc_id")
    score = scoring.opportunity_score(pick(("IDENTIFIED", "NOT_IDENTIFIED", "UNKNOWN"), doc), pick(("none", "basic", "moderate", "strong"), doc), F.col("source"), F.when(F.col("lang") == "en", "x"), F.when(doc % 5 == 0, "Hair salon"), F.col("ai"))
    return j.select("doc_id", score.cast("int").alias("score"))


@query("SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, nullif(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), '') AS t FROM documents)")
def normalize_names(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("SELECT page_id, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#:]*)', 1), '^www\\.', ''), '') AS host FROM pages")
def website_host(spark, d):
    return table(spark, d, "pages").select("page_id", text.website_host(F.col("url")).alias("host"))


@query("SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)")
def html_strip(spark, d):
    t = table(spark, d, "pages").select("page_id", html.visible_text(F.col("html"), None).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("SELECT page_id, len(h) AS n_links, array_to_string(h, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) AS h FROM pages)")
def link_extract(spark, d):
    h = table(spark, d, "pages").select("page_id", html.links(F.col("html")).alias("h"))
    return h.select("page_id", F.size("h").cast("long").alias("n_links"), F.array_join("h", " ").alias("links"))


NUMBERS = ("(11) 99999-9999", "11999999999", "+5511999999999", "005511999999999", "(11) 3456-3456", "99999-9999", "555511999999999", "+5565999999999; +5565888888888", "https://wa.me/5565999999999", "yes", "123", "5599999999", "0800123456", "+1 415 555 0132", "5555999999999")
_RECIPIENTS = ("5511999999999", "5511999999999", "5511999999999", "5511999999999", "551134563456", None, None, "5565999999999", "5565999999999", None, None, "555599999999", None, "5514155550132", None)


@query(
    "SELECT CAST(id AS BIGINT) AS id, phone, recipient FROM (VALUES "
    + ", ".join(f"({n}, {(d := ''.join(c for c in p if c.isdigit())) and (repr(d[2:] if d.startswith('00') else d) if len(d) >= 8 else 'NULL') or 'NULL'}, {r!r})" for n, (p, r) in enumerate(zip(NUMBERS, _RECIPIENTS))).replace("None", "NULL")
    + ") v(id, phone, recipient)"
)
def phone_normalize(spark, d):
    rows = spark.createDataFrame(list(enumerate(NUMBERS)), "id long, p string")
    return rows.select("id", text.normalize_phone(F.col("p")).alias("phone"), text.whatsapp_recipient(F.col("p"), F.lit(None).cast("string")).alias("recipient"))


TIMES = {"1573317070": "2019-11-09 16:31:10", "1573317070000": "2019-11-09 16:31:10", "2019-11-09T00:00:00Z": "2019-11-09 00:00:00", "not-a-date": None, "": None, "-5": None, "2019-11-09T02:00:00+02:00": "2019-11-09 00:00:00", "99999999999999999999999": None}


@query(f"SELECT CAST(id AS BIGINT) AS id, instant FROM (VALUES {', '.join(f'({n}, {v!r})' for n, v in enumerate(TIMES.values())).replace('None', 'NULL')}) v(id, instant)")
def source_timestamps(spark, d):
    rows = spark.createDataFrame(list(enumerate(TIMES)), "id long, t string")
    return rows.select("id", stamp(geo.source_timestamp(F.col("t"))).alias("instant"))


@query(
    """SELECT c_custkey AS id, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS km FROM (SELECT c_custkey, pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2) AS h
  FROM (SELECT c_custkey, c_nationkey * 3.0 - 40 AS lat1, c_acctbal / 100 AS lon1, c_custkey % 90 - 45.0 AS lat2, c_nationkey * 5.0 - 60 AS lon2 FROM customer))"""
)
def geo_distance(spark, d):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.round(geo.haversine_km(n * 3.0 - 40, F.col("c_acctbal") / 100, k % 90 - F.lit(45.0), n * 5.0 - 60), 3).alias("km"))


@query("SELECT c_custkey AS lead_id, replace(replace(replace(replace('Oi {{nome}} de {{cidade}}, {{nicho}} {{instagram}}!', '{{nome}}', c_name), '{{cidade}}', n_name), '{{nicho}}', c_mktsegment), '{{instagram}}', '') AS message FROM customer JOIN nation ON c_nationkey = n_nationkey")
def template_render(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: a fixed list of countries
    message = text.render_template(F.lit("Oi {{nome}} de {{cidade}}, {{nicho}} {{instagram}}!"), nome=F.col("c_name"), cidade=F.col("n_name"), nicho=F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("lead_id"), message.alias("message"))


#: Pages with JSON-LD that tests read.
LD = (
    '<script type="application/ld+json">{"sameAs": "https://a.example/1"}</script>', '<script type="application/ld+json">{"sameAs": ["https://a.example/1", "https://b.example/2", "ftp://no"]}</script>',
    '<script type="application/ld+json">[{"sameAs": "https://c.example"}]</script>', '<script type="application/ld+json">{"@graph": [{"x": {"sameAs": ["https://d.example"]}}]}</script>', '<script type="application/ld+json">{broken</script>', "no script",
)


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY ALL")
def idempotent_events(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", "value").distinct().groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS owner_id, count(*) AS total_elements, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM customer GROUP BY 1")
def page_totals(spark, d):
    return latest.page_totals(table(spark, d, "customer").select(F.col("c_nationkey").alias("owner_id")), latest.rest_page_size(None), ["owner_id"])


@query("SELECT r.pos, c_custkey, c_name FROM (SELECT unnest([7, 3, 999999999, 11, 5]) AS k, generate_subscripts([7, 3, 999999999, 11, 5], 1) - 1 AS pos) r JOIN customer ON c_custkey = k")
def in_requested_order(spark, d):
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (7, 3, 999999999, 11, 5))).cast("array<long>")).alias("pos", "c_custkey")).withColumn("pos", F.col("pos").cast("long"))
    return latest.in_requested_order(table(spark, d, "customer").select("c_custkey", "c_name"), asked, "c_custkey").select("pos", "c_custkey", "c_name")


@query(
    """WITH r AS (SELECT o_orderkey AS id, o_orderdate AS started, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS target, o_orderpriority AS niche FROM orders), t AS (SELECT c_custkey AS target, '3-MEDIUM' AS niche FROM customer),
  a AS (SELECT target, arg_max(id, (started, id)) AS id FROM r WHERE target IS NOT NULL GROUP BY 1), b AS (SELECT niche, arg_max(id, (started, id)) AS id FROM r GROUP BY 1)
  SELECT t.target, coalesce(a.id, b.id) AS run_id FROM t LEFT JOIN a ON a.target = t.target LEFT JOIN b ON b.niche = t.niche"""
)
def latest_run_with_fallback(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("target"), F.col("o_orderpriority").alias("niche"))
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("target"), F.lit("3-MEDIUM").alias("niche"))
    return latest.latest_with_fallback(targets, runs, [["target"], ["niche"]], ["at", "id"], ["id"]).select("target", "run_id")


@query(f"SELECT lead_id AS recipient, min(id) AS id FROM {SQL_SENDS} s WHERE status = 'FAILED' AND NOT EXISTS (SELECT 1 FROM {SQL_SENDS} b WHERE b.lead_id = s.lead_id AND b.status = 'SENDING') GROUP BY 1")
def enqueue_free(spark, d):
    s = sends(spark, d).select(F.col("lead_id").alias("recipient"), "id", "status")
    return state.enqueue(s.where("status = 'FAILED'"), s.where("status = 'SENDING'")).select("recipient", "id")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE strftime(o_orderdate + INTERVAL 30 DAYS, '%Y-%m-%d') END AS retry_after, substring(repeat(o_orderpriority, 400), 1, 2000) AS details FROM orders")
def scan_state_rows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "QUALIFIED").otherwise("NO_PHONE").alias("outcome"), F.repeat("o_orderpriority", 400).alias("details"), "o_orderdate")
    return state.scan_state(o, F.col("o_orderdate").cast("timestamp")).select("id", F.date_format("retry_after", "yyyy-MM-dd").alias("retry_after"), "details")


@query("SELECT doc_id, md5(regexp_replace(text, '(?i)(password|token|secret|url|database_url|key)=[^\\s&]+', '\\1=***', 'g')) AS redacted, '***' || right(regexp_replace(text, '[^0-9]', '', 'g'), 4) AS masked, substring(text, 1, 500) AS shortened FROM documents")
def redact_and_mask(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.redact(t)).alias("redacted"), text.mask_phone(t).alias("masked"), text.shortened(t, 500).alias("shortened"))


@query("SELECT event_id, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS attempt FROM events")
def attempt_numbers(spark, d):
    return state.attempts(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "click").select("event_id", "attempt")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY ts, event_id)) > 1 AS seen FROM events")
def seen_in_run(spark, d):
    key = F.struct("user_id", "event_type", "value")
    return dedup.seen_before(table(spark, d, "events"), key, [F.col("ts"), F.col("event_id")]).select("event_id", "seen")


FEATURES = (
    '\x1e{"type":"Feature","properties":{"@type":"node","@id":4,"@timestamp":1573317070,"name":"Café Ñandú","shop":"beauty","addr:street":"Rua A","addr:housenumber":"5","phone":"(11) 99999-9999"},"geometry":{"type":"Point","coordinates":[-46.5,-23.5]}}',
    '{"properties":{"type":"way","id":"way/12","tags":{"shop":"clothes","beauty":"nails"},"shop":"hairdresser"},"geometry":{"type":"LineString","coordinates":[[1.5,2.5],[3,4]]}}',
    '{"properties":{"@type":"relation","@id":7},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,2],[0,2],[0,0]]]]}}',
    '{"properties":{"@id":8},"geometry":{"type":"Point","coordinates":[1,2]}}', "", "no json", '{"properties":{"@type":"node","@id":9},"geometry":null}',
)


@query("SELECT * FROM (VALUES ('node', CAST(4 AS BIGINT), 'cafe nandu', CAST(-23.5 AS DOUBLE), CAST(-46.5 AS DOUBLE), '2019-11-09 16:31:10', 'Rua A, 5', 'shop:beauty'), ('way', 12, '', 2.5, 1.5, NULL, '', 'beauty:nails'), ('relation', 7, '', 1.0, 2.0, NULL, '', NULL)) v(osm_type, osm_id, normalized_name, latitude, longitude, source_timestamp, address, category)")
def geojson_features(spark, d):
    f = geojson.features(spark.createDataFrame([(x,) for x in FEATURES], "value string"))
    return f.select("osm_type", "osm_id", "normalized_name", "latitude", "longitude", stamp("source_timestamp").alias("source_timestamp"), "address", geojson.category(F.col("tags")).alias("category"))
