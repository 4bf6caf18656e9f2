"""Who of a campaign's leads can be written to: batched reads of analyses, sends and other campaigns' blocking sends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import materialized
from . import funnel
from .latest import latest_by


def blocking_of_recipients(sends: DataFrame) -> DataFrame:
    """``recipient``, its first blocking send (``first_campaign``, ``first_status``) and ``next_status``, the first one of another campaign.

    For any campaign one of the two is the first blocking send of all others, so no
    recipient's sends are joined with one another or gathered. ``sends`` may be
    single ones or the first blocking one of each campaign and recipient already.
    """
    blocking = sends.where(F.col("status").isin(*funnel.BLOCKING) & F.col("recipient").isNotNull())
    by_campaign = blocking.groupBy("recipient", "campaign_id").agg(F.min(F.struct("id", "status")).alias("s")).select("recipient", F.struct("s.id", "campaign_id", "s.status").alias("s"))
    first = by_campaign.groupBy("recipient").agg(F.min("s").alias("first"))
    later = by_campaign.join(first, "recipient").where(F.col("s.campaign_id") != F.col("first.campaign_id")).groupBy("recipient").agg(F.min("s").alias("next"))
    return first.join(later, "recipient", "left").select("recipient", F.col("first.campaign_id").alias("first_campaign"), F.col("first.status").alias("first_status"), F.col("next.status").alias("next_status"))


def messaging_leads(members: DataFrame, leads: DataFrame, analyses: DataFrame, sends: DataFrame) -> DataFrame:
    """One row per campaign and lead asked for: analysis, latest send of the campaign, number of the lead's sends, and eligibility.

    ``members``: campaign_id, lead_id, member (whether the bridge has the pair).
    ``leads``: lead_id, phone, country, do_not_contact. ``analyses``: lead_id, score.
    ``sends``: id, campaign_id, lead_id, recipient, status, attempts, created_at.
    Own blocking sends come before those of other campaigns to the same recipient.
    """
    pair = ["campaign_id", "lead_id"]
    recipients = leads.withColumn("recipient", text.whatsapp_recipient(F.col("phone"), F.col("country")))
    # the sends are read once: what follows needs no more than this of each campaign, lead and recipient
    blocks = F.col("status").isin(*funnel.BLOCKING)
    of_each = {"latest": F.max(F.struct("created_at", "id", "status", "attempts")), "own": F.max(F.when(blocks, F.struct("created_at", "id", "status"))), "first": F.min(F.when(blocks, F.struct("id", "status")))}
    met = materialized(sends.groupBy(*pair, "recipient").agg(F.count("*").alias("n"), *(c.alias(k) for k, c in of_each.items())))
    own = met.groupBy(*pair).agg(F.max("latest").alias("latest"), F.max("own").alias("own")).select(*pair, F.struct("latest.id", "latest.status", "latest.attempts").alias("latest"), F.col("own.status").alias("own_status"))
    totals = met.groupBy("lead_id").agg(F.sum("n").alias("n_sends"))
    first = met.where("first IS NOT NULL").select("recipient", "campaign_id", "first.id", "first.status")
    rows = members.join(recipients, "lead_id").join(latest_by(analyses, "lead_id", ["score"], ["score"]), "lead_id", "left")
    rows = rows.join(own, pair, "left").join(totals, "lead_id", "left").join(blocking_of_recipients(first), "recipient", "left")
    other = F.when(F.col("first_campaign") != F.col("campaign_id"), F.col("first_status")).otherwise(F.col("next_status"))
    code = funnel.eligibility(F.col("member"), F.col("do_not_contact"), F.col("phone"), F.col("recipient"), F.col("own_status"), other)
    return rows.select(
        *pair, "score", "recipient", F.col("latest.id").alias("latest_id"), F.col("latest.status").alias("latest_status"), F.coalesce("latest.attempts", F.lit(0)).cast("long").alias("attempts"),
        F.coalesce("n_sends", F.lit(0)).alias("n_sends"), code.isNull().alias("eligible"), code.alias("code"),
    )


def eligibility_counts(rows: DataFrame, by: str = "campaign_id") -> DataFrame:
    """Eligible and ineligible leads of each campaign."""
    return rows.groupBy(by).agg(F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("ineligible"))
