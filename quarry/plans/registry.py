"""Queries over the registry of niches, which is a table: rules, aliases, catalog pages.

Places are events with tags written from their ids, texts whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import latest, niches, rules
from ..sources.tables import table
from .crm import pick, query, sql_pick

SHOPS = ("beauty", " Beauty ", "hairdresser", "nail_salon", "clothes", "barber", "pet", "")
BEAUTIES = ("nails", "nails;eyebrow", "manicure; Pedicure", "massage", "", "eyelash", "hair_removal;", ";")
AMENITIES = ("", "cafe", "Dentist", "doctors", "restaurant")
NAMES = ("nails studio", "bella", "bella esmalteria", "snail store", "beleza pura", "", "unha & spa", "Salão da Ana", "Barbearia do Zé", "Clínica de Estética")
#: What the names show, written out: the niche and its first alias.
SHOWN = (
    ("nails studio", "nails", "nails"), ("bella esmalteria", "nails", "esmalteria"), ("beleza pura", "beauty", "beleza"), ("unha & spa", "nails", "unha"), ("unha & spa", "massage", "spa"),
    ("Salão da Ana", "hairdresser", "salao"), ("Barbearia do Zé", "barber", "barbearia"), ("Clínica de Estética", "beauty", "estetica"), ("Clínica de Estética", "clinic", "clinica"),
)
#: The rules that these tags can meet, written out: niche, strong rule, rule of context. s: shop, b: parts of beauty, a: amenity.
RULES = (
    ("beauty", "s = 'beauty'", "s = 'beauty'"),
    ("eyelash", "s = 'beauty' AND list_contains(b, 'eyelash')", "s IN ('beauty', 'hairdresser')"),
    ("eyebrow", "s = 'beauty' AND list_contains(b, 'eyebrow')", "s IN ('beauty', 'hairdresser')"),
    ("nails", "s IN ('beauty', 'hairdresser') AND list_has_any(b, ['nails', 'manicure', 'pedicure']) OR s = 'nail_salon'", "s IN ('beauty', 'hairdresser', 'nail_salon')"),
    ("hairdresser", "s IN ('beauty', 'hairdresser')", "s IN ('beauty', 'hairdresser')"),
    ("barber", "s = 'barber'", "s IN ('barber', 'hairdresser')"),
    ("dentist", "a = 'dentist'", "a = 'dentist'"),
    ("clinic", "a = 'doctors'", "a = 'doctors'"),
    ("massage", "s = 'beauty' AND list_contains(b, 'massage')", "s = 'beauty' AND list_contains(b, 'massage')"),
    ("hair_removal", "s = 'beauty' AND list_contains(b, 'hair_removal')", "s = 'beauty'"),
    ("beauty_generic", "s = 'beauty'", "s = 'beauty'"),
    ("restaurant", "a = 'restaurant'", "a = 'restaurant'"),
    ("cafe", "a = 'cafe'", "a = 'cafe'"),
    ("pet", "s = 'pet'", "s = 'pet'"),
)
SQL_PLACES = f"""(SELECT *, lower(trim(shop)) AS s, list_transform(string_split(lower(beauty), ';'), lambda x: trim(x)) AS b, lower(amenity) AS a
  FROM (SELECT event_id AS id, {sql_pick(SHOPS, 'event_id')} AS shop, {sql_pick(BEAUTIES, 'event_id // 8')} AS beauty, {sql_pick(AMENITIES, 'event_id // 3')} AS amenity, {sql_pick(NAMES, 'event_id // 7')} AS name FROM events))"""
SQL_HELD = " UNION ALL ".join(f"SELECT id, name, '{n}' AS niche, {strong} AS strong, {context} AS context FROM p" for n, strong, context in RULES)
SQL_CLASSIFIED = f"""WITH p AS {SQL_PLACES}, held AS ({SQL_HELD}), shown AS (SELECT * FROM (VALUES {', '.join(map(repr, SHOWN))}) v(name, niche, alias)),
  met AS (SELECT id, h.niche, strong, context, alias FROM held h LEFT JOIN shown ON shown.name = h.name AND shown.niche = h.niche),
  classified AS (SELECT *, CASE WHEN strong THEN 'STRUCTURED_RULE' WHEN context AND alias IS NOT NULL THEN 'NAME_FALLBACK' ELSE 'NO_MATCH' END AS kind FROM met WHERE strong OR context OR alias IS NOT NULL)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "value")
    n = lambda k: F.floor(F.col("id") / k)
    tags = F.create_map(F.lit("shop"), pick(SHOPS, F.col("id")), F.lit("beauty"), pick(BEAUTIES, n(8)), F.lit("amenity"), pick(AMENITIES, n(3)))
    return e.select("id", "user_id", "value", tags.alias("tags"), pick(NAMES, n(7)).alias("name"))


@query(f"{SQL_CLASSIFIED} SELECT id, niche, strong, context, alias, kind FROM classified")
def rule_exact_token(spark, d):
    """Every niche that an event's tags or name speak for."""
    conditions, aliases = rules.registry(spark)
    return rules.classified(places(spark, d), conditions, aliases)


@query(
    f"""{SQL_CLASSIFIED} SELECT id, name, user_id FROM (SELECT p.id, p.name, user_id FROM p JOIN events ON event_id = p.id JOIN classified c ON c.id = p.id AND c.niche = 'nails' AND kind <> 'NO_MATCH'
  WHERE value >= 2 AND user_id % 10 <> 3 AND user_id % 7 <> 1 AND p.name <> '') ORDER BY name, id LIMIT 300 OFFSET 20"""
)
def catalog_page(spark, d):
    """A page of the places that the niche ``nails`` can take."""
    conditions, aliases = rules.registry(spark)
    user = F.col("user_id")
    rows = places(spark, d).withColumns({"active": F.col("value") >= 2, "qualified": F.lit(True), "whatsapp_verified": user % 10 != 3, "instagram_validated": F.lit(True), "phone": F.lit("5511999999999"), "instagram": F.when(user % 7 != 1, "studio").otherwise(" ")})
    found = rules.catalog(rows, conditions, aliases, "nails").select("id", "name", "user_id")
    return latest.page(found, [F.col("name"), F.col("id")], 20, 300)


@query(
    f"""WITH k AS (SELECT doc_id, regexp_replace(strip_accents(lower(trim(coalesce(text, '')))), '\\s+', ' ', 'g') AS key, trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\\p{{L}}0-9]+', ' ', 'g')) AS phrase FROM documents),
  al AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{n.name}', {i})" for i, (n, a) in enumerate((n, a) for n in niches.NICHES for a in n.aliases if a.isascii()))}) v(alias, niche, pos)),
  m AS (SELECT doc_id, key, phrase, alias, niche, row_number() OVER (PARTITION BY doc_id ORDER BY alias = key DESC NULLS LAST, length(alias) DESC NULLS LAST, pos) AS r FROM k LEFT JOIN al ON contains(key, alias))
  SELECT doc_id, niche, alias, CASE WHEN niche IS NULL THEN md5(phrase) END AS own FROM m WHERE r = 1"""
)
def niche_resolve(spark, d):
    """The niche of every whole document, as if it were asked for: the longest alias that stands anywhere in it."""
    _, aliases = rules.registry(spark)
    found = table(spark, d, "documents").select("doc_id", rules.resolved(aliases, F.col("text")).alias("x"))
    known = F.col("x.alias").isNotNull()
    return found.select("doc_id", F.when(known, F.col("x.niche")).alias("niche"), "x.alias", F.when(~known, F.md5("x.niche")).alias("own"))
