"""The pool of qualified places: pages of candidates, and the rows that an accepted candidate becomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .latest import due_first, page, pool_page_size

FLAGS = ("active", "qualified", "whatsapp_verified", "instagram_validated")
STRINGS = ("normalized_phone", "normalized_instagram", "business_name")


def eligible() -> Column:
    """All flags are true and no string is missing or blank."""
    return reduce(Column.__and__, [*map(F.col, FLAGS), *(F.trim(c) != "" for c in STRINGS)])


def pool_page(places: DataFrame, niches: DataFrame, target_id: int, wanted: int, offset: int) -> DataFrame:
    """A page of a target's eligible places by name and id, with ``has_more``: whether the page is full."""
    size = pool_page_size(wanted)
    of_target = niches.where((F.col("target_id") == target_id) & F.col("niche_active")).select(F.col("place_id").alias("id"), "target_id").distinct()
    rows = page(places.where(eligible()).join(of_target, "id"), [F.col("normalized_name"), F.col("id")], max(offset, 0), size)
    return rows.withColumn("has_more", F.count("*").over(Window.partitionBy("target_id")) == size)


def candidates(rows: DataFrame) -> DataFrame:
    """Places of the pool as candidates: the raw phone and handle if there is one, else the normalised; places without an id are left out."""
    raw = F.coalesce("instagram", "normalized_instagram")
    handle = text.present(text.instagram_handle(text.present(raw)))
    out = rows.where(F.col("osm_type").isNotNull() & F.col("osm_id").isNotNull())
    return out.select(
        F.trim("business_name").alias("business_name"), F.lit("openstreetmap").alias("source"), F.concat_ws("/", "osm_type", F.col("osm_id").cast("string")).alias("source_id"),
        F.coalesce("phone", "normalized_phone").alias("phone"), "website", "email", "city", handle.alias("instagram_username"), F.concat(F.lit("https://instagram.com/"), handle).alias("instagram_url"),
        F.when(handle.isNull(), "NOT_FOUND").otherwise("FOUND").alias("instagram_status"), F.lit("QUALIFIED_POOL").alias("niche_match_type"), *(c for c in ("has_more",) if c in rows.columns),
    )


def lead_rows(accepted: DataFrame, campaign: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leads, their places in the campaign and their sources, of accepted candidates with the id that each is to have."""
    handle = F.coalesce("instagram_username", "instagram_url")
    leads = accepted.select(
        "lead_id", "business_name", text.normalize_name(F.col("business_name")).alias("normalized_name"), "phone", text.normalize_phone(F.col("phone")).alias("normalized_phone"), "email",
        text.normalize_email(F.col("email")).alias("normalized_email"), "website", text.website_host(F.col("website")).alias("normalized_website"), text.instagram_handle(handle).alias("normalized_instagram"),
        text.source_key(F.col("source"), F.col("source_id")).alias("normalized_source_id"), F.lit(False).alias("do_not_contact"), F.lit("NEW").alias("status"), campaign.alias("current_campaign_id"),
    )
    return leads, accepted.select(campaign.alias("campaign_id"), "lead_id"), accepted.select("lead_id", "source", "source_id", F.col("website").alias("source_url"))


def claim_next(sends: DataFrame, as_of: Column) -> DataFrame:
    """``sends`` after one tick of the queue: the next due send is being sent, with one more attempt.

    One due send is a table of one row, so its join is a broadcast of bounded size.
    """
    claimed = due_first(sends, as_of).select("id", F.lit(True).alias("__claimed"))
    mine = F.coalesce("__claimed", F.lit(False))
    out = sends.join(F.broadcast(claimed), "id", "left")
    changes = {"status": F.lit("SENDING"), "attempts": F.col("attempts") + 1, "last_attempt_at": as_of}
    return out.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("__claimed")


def contact_status(phone: Column) -> Column:
    """What is written where no status is yet, by whether there is a phone."""
    return F.when(F.trim(phone) != "", "LEGACY_PHONE").otherwise("NO_PHONE")
