"""Rows as they are shown: a lead with its analysis, message and campaign, and a run with its region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANALYSIS = ("business_type", "digital_presence", "booking_system_status", "detected_system", "opportunity_score", "analyzed_at")
MESSAGE = ("message_text", "edited", "approved", "generated_at", "edited_at")


def _joined(rows: DataFrame, others: DataFrame, name: str, columns: tuple[str, ...], key: str, other_key: str) -> DataFrame:
    """``rows`` with the struct ``name`` of the other table's row (one for each key, at most), null if there is none."""
    value: Column = F.struct(*(c for c in columns if c in others.columns))
    own = others.where(F.col(other_key).isNotNull()).select(F.col(other_key).alias("__key"), value.alias(name))
    return rows.join(own, F.col(key) == F.col("__key"), "left").drop("__key")


def lead_responses(leads: DataFrame, analyses: DataFrame, messages: DataFrame, campaigns: DataFrame) -> DataFrame:
    """``leads`` with ``analysis``, ``message`` (structs, null if there is none) and ``campaign_name``.

    Leads have ``lead_id`` and ``current_campaign_id``; analyses and messages have
    ``lead_id``, one row for a lead at most; campaigns ``campaign_id`` and ``name``.
    Three left joins by key, so each lead stays one row.
    """
    out = _joined(leads, analyses, "analysis", ANALYSIS, "lead_id", "lead_id")
    out = _joined(out, messages, "message", MESSAGE, "lead_id", "lead_id")
    return _joined(out, campaigns, "__campaign", ("name",), "current_campaign_id", "campaign_id").withColumn("campaign_name", F.col("__campaign.name")).drop("__campaign")


def run_responses(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """``runs`` (``region_id``, ``target_id`` or null) with the ``city``, ``state`` and ``country`` of their region."""
    return _joined(runs, regions, "__region", ("city", "state", "country"), "region_id", "region_id").withColumns({c: F.col(f"__region.{c}") for c in ("city", "state", "country")}).drop("__region")
