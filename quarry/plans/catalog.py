"""Queries over the catalog of places: countries and states, candidates, pool pages, new leads, claims, codes and labels.

Stand-ins as in ``crm``: places are customers, whose columns are written from their keys in the ways that the rules tell apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, places
from ..operators import pool
from ..sources.tables import table
from .crm import STATUSES, now, pick, query, sends, sql_in, sql_pick, stamp

COUNTRIES = ("Brasil", " BRAZIL ", "France", "França", "México", "Estados  Unidos", "USA", "uk", "Itália", "de", "JP", "xx", "")
CITIES = ("São Paulo", " sao  paulo ", "Campinas", "SÃO PAULO", "", "Sao-Paulo")
STATE_NAMES = ("São Paulo", "SP", " Goiás", "Pará", "rio grande  do sul", "Bahia", "Texas", "")
FOLD = "regexp_replace(strip_accents(lower(trim({}))), '\\s+', ' ', 'g')"


def sql_map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


SQL_CODE = f"coalesce({sql_map(places.COUNTRY_ALIASES)}[{FOLD.format('country')}], CASE WHEN {FOLD.format('country')} IN {sql_in((*places.COUNTRY_NAMES, 'jp'))} THEN {FOLD.format('country')} END)"
SQL_COUNTRIES = f"(SELECT *, {SQL_CODE} AS code FROM (SELECT c_custkey AS id, {sql_pick(COUNTRIES, 'c_custkey')} AS country FROM customer))"
SQL_NAME = f"CASE WHEN code IS NULL THEN '' ELSE coalesce({sql_map(places.COUNTRY_NAMES)}[code], upper(code)) END"


def countries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), pick(COUNTRIES, F.col("c_custkey")).alias("country"))
    return rows.withColumn("code", places.country_code(F.col("country"), places.iso_countries(spark)))


@query(f"SELECT id, country, code, {SQL_NAME} AS name FROM {SQL_COUNTRIES}")
def country_codes(spark, d):
    return countries(spark, d).withColumn("name", places.country_name(F.col("code")))


@query(f"SELECT code, {SQL_NAME} AS name, count(*) AS n FROM {SQL_COUNTRIES} WHERE code IS NOT NULL GROUP BY code ORDER BY name")
def countries_by_name(spark, d):
    return countries(spark, d).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n")).select("code", places.country_name(F.col("code")).alias("name"), "n").orderBy("name")


SQL_STATES = sql_map(places.STATES)


@query(f"""SELECT id, {SQL_STATES}[{FOLD.format('state')}] AS extract, {FOLD.format('hit')} = {FOLD.format('asked')} AS same_city FROM
  (SELECT c_custkey AS id, {sql_pick(STATE_NAMES, 'c_custkey')} AS state, {sql_pick(CITIES, 'c_custkey')} AS hit, {sql_pick(CITIES, 'c_custkey // 6')} AS asked FROM customer)""")
def extracts_of_states(spark, d):
    k = F.col("c_custkey")
    hit, asked = pick(CITIES, k), pick(CITIES, F.floor(k / 6))
    return table(spark, d, "customer").select(k.alias("id"), places.extract_of_state(pick(STATE_NAMES, k)).alias("extract"), places.same_city(hit, asked).alias("same_city"))


@query(f"""SELECT id, CASE WHEN lower(country) IS DISTINCT FROM 'br' THEN 'OSM_CATALOG_COUNTRY_NOT_SUPPORTED' WHEN trim(city) = '' OR trim(niche) = '' THEN 'OSM_SYNC_INVALID_INPUT' END AS request, CASE WHEN trim(niche) = '' OR region IS NULL THEN 'OSM_TARGET_CONFIGURATION_REQUIRED' END AS resync
  FROM (SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 = 1 THEN 'us' WHEN c_nationkey % 4 <> 2 THEN 'BR' END AS country, {sql_pick(CITIES, 'c_custkey')} AS city, CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_mktsegment END AS niche, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS region FROM customer)""")
def target_checks(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    country = F.when(n % 4 == 1, "us").when(n % 4 != 2, "BR")
    niche = F.when(k % 7 == 0, "  ").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select(k.alias("id"), places.request_problem(country, pick(CITIES, k), niche).alias("request"), places.resync_problem(niche, F.when(k % 5 != 0, n)).alias("resync"))


SQL_TAGS = f"""(SELECT c_custkey AS id, c_custkey % 3 = 0 AS verified, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS tname, CASE WHEN c_custkey % 2 = 0 THEN 'Rua ' || c_nationkey END AS street, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 90 AS VARCHAR) END AS house, CASE WHEN c_custkey % 4 = 0 THEN 'Centro' END AS suburb,
  nullif(trim({sql_pick(CITIES, 'c_custkey')}), '') AS city, CASE WHEN c_custkey % 7 = 0 THEN 'RJ' END AS tstate, CASE WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) END AS shop, CASE WHEN c_custkey % 5 = 1 THEN 'cafe' END AS amenity,
  CASE WHEN c_custkey % 4 = 1 THEN 'm' || c_custkey END AS mobile, CASE WHEN c_custkey % 6 = 1 THEN 'p' || c_custkey END AS phone, CASE WHEN c_custkey % 4 = 3 THEN 'u.' || c_custkey END AS handle FROM customer)"""


def tags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    word = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    pairs = {
        "name": F.when(k % 11 != 0, F.col("c_name")), "addr:street": F.when(k % 2 == 0, word("Rua ", F.col("c_nationkey"))), "addr:housenumber": F.when(k % 5 != 0, (k % 90).cast("string")), "addr:district": F.when(k % 4 == 0, F.lit("Centro")),
        "addr:town": pick(CITIES, k), "addr:state": F.when(k % 7 == 0, "RJ"), "shop": F.when(k % 3 == 1, F.lower("c_mktsegment")), "amenity": F.when(k % 5 == 1, "cafe"), "mobile": F.when(k % 4 == 1, word("m", k)), "phone": F.when(k % 6 == 1, word("p", k)),
        "instagram": F.when(k % 4 == 3, word("https://instagram.com/U.", k)),
    }
    return table(spark, d, "customer").select(k.alias("id"), (k % 3 == 0).alias("verified"), F.create_map(*(x for key, v in pairs.items() for x in (F.lit(key), v))).alias("tags"))


@query(f"""SELECT id, tname AS business_name, coalesce('shop:' || shop, 'amenity:' || amenity) AS category, coalesce(phone, mobile) AS phone, coalesce(city, 'sao paulo') AS city, coalesce(tstate, 'SP') AS state, handle AS instagram, CASE WHEN handle IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS instagram_status,
  concat_ws(', ', nullif(concat_ws(' ', street, house), ''), suburb, concat_ws(' - ', coalesce(city, CASE WHEN verified THEN 'sao paulo' END), coalesce(tstate, 'SP'))) AS address
  FROM {SQL_TAGS} WHERE tname IS NOT NULL AND (verified OR coalesce({FOLD.format('city')} = 'sao paulo', false))""")
def place_candidates(spark, d):
    c = places.candidate_of(F.col("tags"), F.col("id").cast("string"), F.lit("sao paulo"), F.lit("SP"), F.lit("br"), F.col("verified"))
    rows = tags(spark, d).select("id", c.alias("c")).where("c IS NOT NULL")
    return rows.select("id", "c.business_name", "c.category", "c.phone", "c.city", "c.state", "c.instagram", "c.instagram_status", "c.address")


SQL_PLACES = """(SELECT c_custkey AS id, lower(c_name) AS normalized_name, c_custkey % 10 <> 0 AS active, c_custkey % 7 <> 1 AS qualified, c_acctbal > -500 AS whatsapp_verified, CASE WHEN c_custkey % 13 <> 2 THEN true END AS instagram_validated,
  CASE WHEN c_custkey % 17 <> 3 THEN '55119' || c_custkey ELSE ' ' END AS normalized_phone, CASE WHEN c_custkey % 19 <> 4 THEN 'user' || c_custkey END AS normalized_instagram, ' ' || c_name AS business_name, CASE WHEN c_custkey % 3 = 0 THEN '(11) 9' || c_custkey END AS phone,
  CASE WHEN c_custkey % 4 = 0 THEN '@Raw' || c_custkey WHEN c_custkey % 4 = 1 THEN '' END AS instagram, c_nationkey % 2 AS target_id, c_custkey % 9 <> 0 AS niche_active FROM customer)"""
SQL_ELIGIBLE = "active AND qualified AND whatsapp_verified AND instagram_validated AND trim(normalized_phone) <> '' AND trim(normalized_instagram) <> '' AND trim(business_name) <> ''"
SQL_HANDLE = "nullif(lower(ltrim(coalesce(instagram, normalized_instagram), '@')), '')"


def pool_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    word = lambda mark: F.concat(F.lit(mark), k.cast("string"))
    none = F.lit(None).cast("string")
    rows = c.select(
        k.alias("id"), F.lower("c_name").alias("normalized_name"), (k % 10 != 0).alias("active"), (k % 7 != 1).alias("qualified"), (F.col("c_acctbal") > -500).alias("whatsapp_verified"), F.when(k % 13 != 2, True).alias("instagram_validated"),
        F.when(k % 17 != 3, word("55119")).otherwise(" ").alias("normalized_phone"), F.when(k % 19 != 4, word("user")).alias("normalized_instagram"), F.concat(F.lit(" "), "c_name").alias("business_name"),
        F.when(k % 3 == 0, word("(11) 9")).alias("phone"), F.when(k % 4 == 0, word("@Raw")).when(k % 4 == 1, "").alias("instagram"), F.lit("node").alias("osm_type"), k.alias("osm_id"), none.alias("website"), none.alias("email"), none.alias("city"),
    )
    return rows, c.select(k.alias("place_id"), (F.col("c_nationkey") % 2).alias("target_id"), (k % 9 != 0).alias("niche_active"))


@query(f"""SELECT trim(business_name) AS business_name, 'node/' || id AS source_id, coalesce(phone, normalized_phone) AS phone, {SQL_HANDLE} AS instagram_username, CASE WHEN {SQL_HANDLE} IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS instagram_status, count(*) OVER () = 30 AS has_more
  FROM (SELECT * FROM {SQL_PLACES} WHERE {SQL_ELIGIBLE} AND target_id = 1 AND niche_active ORDER BY normalized_name, id LIMIT 30 OFFSET 5)""")
def pool_candidates(spark, d):
    """The page is the feature: 30 places for a target that wants two, from the sixth on."""
    page = pool.candidates(pool.pool_page(*pool_tables(spark, d), target_id=1, wanted=2, offset=5))
    return page.select("business_name", "source_id", "phone", "instagram_username", "instagram_status", "has_more")


SQL_ACCEPTED = f"(SELECT id, trim(business_name) AS business_name, coalesce(phone, normalized_phone) AS phone, {SQL_HANDLE} AS handle FROM {SQL_PLACES} WHERE {SQL_ELIGIBLE})"


def new_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    accepted = pool.candidates(pool_tables(spark, d)[0].where(pool.eligible()))
    return pool.lead_rows(accepted.withColumn("lead_id", F.substring_index("source_id", "/", -1).cast("long")), F.lit(7))


@query(f"""SELECT id AS lead_id, business_name, trim(regexp_replace(lower(business_name), '[^a-z0-9]+', ' ', 'g')) AS normalized_name, CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 8 THEN regexp_replace(regexp_replace(phone, '[^0-9]', '', 'g'), '^00', '') END AS normalized_phone, handle AS normalized_instagram,
  'openstreetmap_node/' || id AS normalized_source_id, 'NEW' AS status, 7 AS current_campaign_id FROM {SQL_ACCEPTED}""")
def new_leads(spark, d):
    return new_rows(spark, d)[0].select("lead_id", "business_name", "normalized_name", "normalized_phone", "normalized_instagram", "normalized_source_id", "status", "current_campaign_id")


@query(f"SELECT 7 AS campaign_id, id AS lead_id, 'openstreetmap' AS source, 'node/' || id AS source_id FROM {SQL_ACCEPTED}")
def new_lead_sources(spark, d):
    _, bridge, sources = new_rows(spark, d)
    return bridge.join(sources, "lead_id").select("campaign_id", "lead_id", "source", "source_id")


SQL_QUEUE = f"""(SELECT o_orderkey AS id, {sql_pick(('QUEUED', 'SENDING', 'SENT', 'DELIVERY_UNKNOWN', 'FAILED', 'SKIPPED'), 'o_orderkey')} AS status, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 3 DAYS END AS due, o_orderkey % 6 + 1 AS attempts, o_orderdate AS last FROM orders)"""


@query(f"""SELECT id, CASE WHEN mine THEN 'SENDING' ELSE status END AS status, attempts + CASE WHEN mine THEN 1 ELSE 0 END AS attempts, strftime(CASE WHEN mine THEN TIMESTAMP '1998-01-01' ELSE last END, '%Y-%m-%d %H:%M:%S') AS last_attempt_at FROM (SELECT *, id = (SELECT id FROM {SQL_QUEUE} WHERE status = 'QUEUED' AND (due IS NULL OR due <= TIMESTAMP '1998-01-01') ORDER BY due NULLS FIRST, id LIMIT 1) AS mine FROM {SQL_QUEUE})""")
def claimed_sends(spark, d):
    return pool.claim_next(sends(spark, d), now()).select("id", "status", "attempts", stamp("last_attempt_at").alias("last_attempt_at"))


@query(f"SELECT id, CASE WHEN trim(normalized_phone) <> '' THEN 'LEGACY_PHONE' ELSE 'NO_PHONE' END AS contact_status FROM {SQL_PLACES}")
def legacy_contact_status(spark, d):
    return pool_tables(spark, d)[0].select("id", pool.contact_status(F.col("normalized_phone")).alias("contact_status"))


KINDS = ("ConnectException", "UnknownHostException", "SocketTimeoutException", "IOException", "NoRouteToHostException", "JavaSocketTimeoutX")
MESSAGES = ("Connect timed out", "Read timed out", "Connection reset", "", "read timeout after connection refused", "closed", "failed to connect")
ANSWERS = (*codes.REMOTE_CODES, "", "other")
SQL_REMOTE = f"coalesce({sql_map(codes.REMOTE_CODES)}[answer], CASE WHEN status = 404 THEN 'WHATSAPP_QR_NOT_AVAILABLE' ELSE 'WHATSAPP_SEND_FAILED' END)"


@query(f"""SELECT id, CASE WHEN kind IN {sql_in(codes.NO_CONNECTION)} THEN 'WHATSAPP_SERVICE_CONNECT_FAILED' WHEN kind = 'SocketTimeoutException' AND contains(m, 'connect') THEN 'WHATSAPP_SERVICE_CONNECT_FAILED' WHEN contains(kind, 'SocketTimeout') THEN 'WHATSAPP_READ_TIMEOUT'
    WHEN contains(m, 'connection refused') OR contains(m, 'connection reset') OR contains(m, 'failed to connect') OR contains(m, 'connect timed out') THEN 'WHATSAPP_SERVICE_CONNECT_FAILED' WHEN contains(m, 'read timed out') OR contains(m, 'read timeout') THEN 'WHATSAPP_READ_TIMEOUT' ELSE 'WHATSAPP_SERVICE_CONNECT_FAILED' END AS network,
  {SQL_REMOTE} AS remote, CASE WHEN {SQL_REMOTE} IN {sql_in(codes.PROVIDER_TERMINAL)} THEN 'TERMINAL' WHEN {SQL_REMOTE} IN {sql_in(codes.PROVIDER_TRANSIENT)} THEN 'TRANSIENT' ELSE 'AMBIGUOUS' END AS failure
  FROM (SELECT event_id AS id, {sql_pick(KINDS, 'event_id')} AS kind, lower({sql_pick(MESSAGES, 'event_id')}) AS m, {sql_pick(ANSWERS, 'event_id')} AS answer, CASE WHEN user_id % 2 = 0 THEN 404 ELSE 500 END AS status FROM events)""")
def error_codes(spark, d):
    k = F.col("event_id")
    remote = codes.remote_error(pick(ANSWERS, k), F.when(F.col("user_id") % 2 == 0, 404).otherwise(500))
    return table(spark, d, "events").select(k.alias("id"), codes.network_error(pick(KINDS, k), pick(MESSAGES, k)).alias("network"), remote.alias("remote"), codes.provider_failure(remote).alias("failure"))


RUNS = ("QUEUED", "RUNNING", *codes.RUN_TERMINAL, "CANCELLED")
SHOWN = (*STATUSES, "ARCHIVED")


def sql_label(status: str, labels: dict[str, tuple[str, str]]) -> str:
    return f"coalesce({sql_map({k: v[0] for k, v in labels.items()})}[{status}], {status})"


@query(f"""SELECT id, run IN {sql_in(codes.RUN_TERMINAL)} AS over, run IN {sql_in(codes.RUN_ACTIVE)} AS active, {sql_label('run', codes.CAMPAIGN_LABELS)} AS campaign_label, {sql_label('lead', codes.LEAD_LABELS)} AS lead_label, coalesce({sql_map({k: v[1] for k, v in codes.LEAD_LABELS.items()})}[lead], 'badge-gray') AS lead_badge
  FROM (SELECT o_orderkey AS id, {sql_pick(RUNS, 'o_orderkey')} AS run, {sql_pick(SHOWN, 'o_orderkey')} AS lead FROM orders)""")
def status_labels(spark, d):
    k = F.col("o_orderkey")
    run, lead = pick(RUNS, k), pick(SHOWN, k)
    return table(spark, d, "orders").select(
        k.alias("id"), codes.run_is_over(run).alias("over"), codes.run_is_active(run).alias("active"), codes.label(run, codes.CAMPAIGN_LABELS).alias("campaign_label"),
        codes.label(lead, codes.LEAD_LABELS).alias("lead_label"), codes.badge(lead, codes.LEAD_LABELS).alias("lead_badge"),
    )


@query("SELECT o_orderkey AS id, o_orderpriority AS name, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place, o_custkey AS owner_id FROM orders WHERE contains(lower(o_orderpriority), 'urg')")
def campaign_search(spark, d):
    """Each owner's campaigns whose name holds a word, newest first."""
    from pyspark.sql import Window

    found = table(spark, d, "orders").where(F.lower("o_orderpriority").contains("urg"))
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return found.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.row_number().over(newest).alias("place"), F.col("o_custkey").alias("owner_id"))
