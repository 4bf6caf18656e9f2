"""Counts by stage: dashboards, campaign counters, eligibility, and the funnel of a sync run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import cases
from ..functions.text import present

#: What each stage of a lead includes.
INTERESTED = ("INTERESTED", "SCHEDULED", "CONVERTED")
REPLIED = ("REPLIED", *INTERESTED)
SENT = ("SENT", *REPLIED)
APPROVED = ("APPROVED", *SENT)
MESSAGE_READY = ("MESSAGE_READY", *APPROVED)
ANALYZED = ("ANALYZED", *MESSAGE_READY)
DASHBOARD = {
    "new_leads": ("NEW", "ANALYZING", "ERROR"),
    "analyzed": ANALYZED,
    "message_ready": ("MESSAGE_READY", "APPROVED"),
    "approved": APPROVED,
    "sent": SENT,
    "replied": REPLIED,
    "interested": INTERESTED,
    "converted": ("CONVERTED",),
    "blocked": ("DO_NOT_CONTACT",),
}
COUNTERS = {"message_count": MESSAGE_READY, "approved_count": APPROVED, "sent_count": SENT, "replied_count": REPLIED, "interested_count": INTERESTED, "converted_count": ("CONVERTED",), "error_count": ("ERROR",)}
BLOCKING = ("QUEUED", "SENDING", "SENT", "DELIVERY_UNKNOWN")


def count_in(status: Column, values: tuple[str, ...]) -> Column:
    return F.count_if(status.isin(*values))


def status_counts(memberships: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Rows by owner and status: memberships, so a lead in two campaigns counts twice."""
    return memberships.groupBy(*by, status).agg(F.count("*").alias("leads"))


def dashboard(memberships: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """One row per owner with the total and the overlapping buckets, in one pass."""
    return memberships.groupBy(*by).agg(F.count("*").alias("total"), *(count_in(F.col(status), v).alias(k) for k, v in DASHBOARD.items()))


def campaign_counters(members: DataFrame, by: str = "campaign_id", status: str = "status", analyzed: str = "analyzed", blocked: str = "do_not_contact") -> DataFrame:
    """All counters of a campaign from its members, in one aggregation."""
    s = F.col(status)
    return members.groupBy(by).agg(F.count("*").alias("discovered_count"), F.count_if(F.col(analyzed)).alias("analyzed_count"), *(count_in(s, v).alias(k) for k, v in COUNTERS.items()), F.count_if(F.col(blocked)).alias("blocked_count"))


def zero_filled(dimension: DataFrame, facts: DataFrame, key: str, fact_key: str, name: str) -> DataFrame:
    """``dimension`` with the number of its facts, 0 without any: counted before the join."""
    counts = facts.groupBy(F.col(fact_key).alias("__k")).agg(F.count("*").alias(name))
    return dimension.join(counts, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.lit(0)))


def eligibility(member: Column, do_not_contact: Column, phone: Column, recipient: Column, own_status: Column, other_status: Column) -> Column:
    """The first reason against a message, null for none.

    ``own_status`` and ``other_status`` are the blocking sends of this campaign and of
    all others to the same recipient.
    """
    blocked = lambda s: cases((s == "QUEUED", "ALREADY_QUEUED"), (s == "SENDING", "ALREADY_SENDING"), (s == "SENT", "ALREADY_SENT"), (s == "DELIVERY_UNKNOWN", "DELIVERY_UNKNOWN"))
    first = cases((~member, "WRONG_CAMPAIGN"), (do_not_contact, "DO_NOT_CONTACT"), (present(phone).isNull(), "NO_PHONE"), (recipient.isNull(), "INVALID_PHONE"))
    return F.coalesce(first, blocked(own_status), blocked(other_status))


def skip_scan(outcome: Column, known: Column, current: Column, version: Column, current_version: str, retry_after: Column, as_of: Column) -> Column:
    """Whether a candidate that was looked at before is passed over; the order of the rules matters."""
    return cases(
        (outcome.isNull(), False), (outcome == "QUALIFIED", True), (current != known, False), (version != current_version, False), (retry_after < as_of, False), otherwise=True
    )


def with_scan_state(candidates: DataFrame, known: DataFrame, keys: list[str], version: str, as_of: Column) -> DataFrame:
    """``candidates`` (with ``stamp``) joined with the state of their last scan, and ``skipped``: one lookup join on the keys."""
    joined = candidates.join(known, keys, "left")
    return joined.withColumn("skipped", skip_scan(F.col("outcome"), F.col("known"), F.col("stamp"), F.col("version"), version, F.col("retry_after"), as_of))


#: Where a candidate can leave the sync funnel, in order.
STAGES = ("NOT_COMMERCIAL", "NOT_POTENTIAL", "SCAN_SKIPPED", "NO_OFFICIAL_CONTACT_CHANNEL", "TECHNICAL_FAILURE", "NICHE_NOT_CONFIRMED", "NO_INSTAGRAM", "NO_PHONE", "DUPLICATE", "NOT_ON_WHATSAPP")


def stage(*passes: Column) -> Column:
    """The first of STAGES whose test fails, QUALIFIED if none does; an unknown test fails."""
    return cases(*((~F.coalesce(p, F.lit(False)), s) for p, s in zip(passes, STAGES, strict=True)), otherwise="QUALIFIED")


def funnel(candidates: DataFrame, by: list[str], stage_col: str = "stage") -> DataFrame:
    """Candidates that left at each stage, those saved, and duplicates of all kinds, in one pass."""
    s = F.col(stage_col)
    return candidates.groupBy(*by).agg(F.count("*").alias("objects_read"), *(F.count_if(s == x).alias(x.lower()) for x in STAGES), F.count_if(s == "QUALIFIED").alias("qualified_saved"))
