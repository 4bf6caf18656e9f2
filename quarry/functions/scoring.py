"""Scores, outcomes and codes: rules that are tried in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits, or_unknown, present

#: Codes of failed sends.
TERMINAL_CODES = ("RECIPIENT_NOT_ON_WHATSAPP", "WHATSAPP_INVALID_RECIPIENT", "INVALID_RECIPIENT", "WHATSAPP_INVALID_TEXT", "INVALID_TEXT", "WHATSAPP_TEXT_TOO_LONG", "TEXT_TOO_LONG", "WHATSAPP_INVALID_REQUEST_ID", "INVALID_REQUEST_ID", "INVALID_TEMPLATE", "WHATSAPP_INVALID_TEMPLATE")
TRANSIENT_CODES = ("WHATSAPP_NOT_CONNECTED", "WHATSAPP_RECIPIENT_CHECK_FAILED", "WHATSAPP_SERVICE_CONNECT_FAILED", "WHATSAPP_SERVICE_UNREACHABLE", "WHATSAPP_AUTH_MISMATCH")
MOST_ATTEMPTS = 5
CATEGORY_WORDS = ("shop", "amenity", "clinic", "beauty", "barber", "hair", "restaurant", "fitness")
ACTIVE = ("CREATED", "DISCOVERING", "ANALYZING", "GENERATING")


def cases(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first pair whose condition holds."""
    return reduce(lambda out, p: out.when(*p), pairs[1:], F.when(*pairs[0])).otherwise(otherwise)


def opportunity_score(booking: Column, presence: Column, website: Column, instagram: Column, category: Column, judged: Column) -> Column:
    """0 to 100: what the signals say, or 65 % of the judged score and 35 % of theirs, rounded half up."""
    signal = (
        cases((booking.isin("IDENTIFIED", "PROBABLE"), 0), (booking == "NOT_IDENTIFIED", 30), otherwise=15)
        + cases((presence == "none", 20), (presence == "basic", 14), (presence == "moderate", 8), otherwise=0)
        + F.when(website.isNotNull(), 5).otherwise(0)
        + F.when(instagram.isNotNull(), 5).otherwise(0)
        + F.when(F.lower(category).rlike("|".join(CATEGORY_WORDS)), 10).otherwise(0)
    )
    signal = F.greatest(F.lit(5), F.least(F.lit(100), signal))
    both = F.greatest(F.lit(0), F.least(F.lit(100), F.floor((65 * judged + 35 * signal) / 100 + 0.5))).cast("int")
    return F.when(judged.isNotNull(), both).otherwise(signal)


def failure_category(code: Column) -> Column:
    return cases((code.isin(*TERMINAL_CODES), "TERMINAL"), (code.isin(*TRANSIENT_CODES), "TRANSIENT"), (code == "PROVIDER_NOT_FOUND", "PROVIDER_NOT_FOUND"), otherwise="AMBIGUOUS")


def retry_minutes(attempts: Column) -> Column:
    """Two to the power of the attempts, as a long."""
    return F.pow(F.lit(2.0), attempts).cast("long")


def after_failure(code: Column, attempts: Column) -> Column:
    """The status of a send after a failure: uncertain deliveries are never tried again."""
    kind = failure_category(code)
    return cases((kind.isin("TERMINAL", "PROVIDER_NOT_FOUND"), "FAILED"), ((kind == "TRANSIENT") & (attempts >= MOST_ATTEMPTS), "FAILED"), (kind == "TRANSIENT", "QUEUED"), otherwise="DELIVERY_UNKNOWN")


def campaign_outcome(status: Column, discovered: Column, requested: Column, errors: Column, analyzed: Column, messages: Column) -> Column:
    return cases(
        (status == "EXHAUSTED", "EXHAUSTED"), (discovered == 0, "FAILED"), ((discovered < requested) | (errors > 0), "PARTIAL"),
        ((analyzed >= requested) & (messages >= requested), "COMPLETED"), otherwise="PARTIAL",
    )


def retry_plan(status: Column, existing: Column, requested: Column) -> Column:
    return cases(
        (status.isin(*ACTIVE), "CAMPAIGN_ALREADY_PROCESSING"), ((status == "FAILED") & (existing == 0), "DISCOVERY"), (status.isin("FAILED", "ERROR"), "ANALYSIS"),
        ((status == "PARTIAL") & (existing < requested), "PARTIAL"), (status == "PARTIAL", "ANALYSIS"), otherwise="INVALID_STATUS",
    )


def run_status(saved: Column, target: Column, technical: Column) -> Column:
    return cases((saved >= target, "SUCCESS"), ((technical > 0) | (saved > 0), "PARTIAL"), otherwise="EXHAUSTED")


def run_exhausted(saved: Column, target: Column, technical: Column) -> Column:
    return (saved < target) & (technical == 0)


def discovery_outcome(accepted: Column, wanted: Column, scanned: Column, duplicates: Column) -> Column:
    """``outcome`` and ``code``."""
    return F.struct(
        cases((accepted >= wanted, "COMPLETE"), (accepted > 0, "PARTIAL"), otherwise="EMPTY").alias("outcome"),
        cases((accepted >= wanted, None), (accepted > 0, "OSM_CATALOG_PARTIAL"), ((scanned > 0) & (duplicates > 0), "OSM_POOL_ALL_DUPLICATES"), otherwise="OSM_NO_USEFUL_LEADS").alias("code"),
    )


def progress_percent(current: Column, total: Column, status: Column) -> Column:
    done = status.isin("COMPLETED", "PARTIAL", "FAILED", "EXHAUSTED")
    return F.when(total > 0, F.floor(100 * current / total + 0.5)).otherwise(F.when(done, 100).otherwise(0)).cast("long")


def budget(base: Column, each: Column, n: Column, most: Column) -> Column:
    return F.least(most, base + n * each)


def tokens_left(left: Column, elapsed_s: Column, capacity: int, window_s: int = 60) -> Column:
    """A bucket refilled in proportion to the time, whole tokens only, up to its capacity."""
    return F.least(F.lit(capacity), left + F.floor(elapsed_s * capacity / window_s)).cast("long")


def valid_send(recipient: Column, text: Column, request_id: Column, most_text: int = 4000) -> Column:
    """Null for a send that may go out, otherwise the first thing wrong with it."""
    return cases(
        (~digits(F.coalesce(recipient, F.lit(""))).rlike("^[0-9]{8,15}$"), "INVALID_RECIPIENT"), (present(text).isNull(), "INVALID_TEXT"), (F.length(text) > most_text, "TEXT_TOO_LONG"),
        (present(request_id).isNull() | (F.length(request_id) > 120), "INVALID_REQUEST_ID"),
    )


ANALYSIS = "business_type string, digital_presence string, booking_system_status string, uses_booking_system string, opportunity_score double"
BOOKING = ("IDENTIFIED", "NOT_IDENTIFIED", "PROBABLE", "UNKNOWN")


def analysis(text: Column) -> Column:
    """An analysis given as JSON, checked: whole scores held to 0..100, unknown words as ``unknown``."""
    j = F.from_json(text, ANALYSIS)
    score = j["opportunity_score"]
    return F.struct(
        or_unknown(j["business_type"]).alias("business_type"), or_unknown(j["digital_presence"]).alias("digital_presence"),
        F.when(j["booking_system_status"].isin(*BOOKING), j["booking_system_status"]).otherwise("UNKNOWN").alias("booking_system_status"),
        F.lower(j["uses_booking_system"]).try_cast("boolean").alias("uses_booking_system"),
        F.when(score == F.floor(score), F.greatest(F.lit(0), F.least(F.lit(100), score.cast("int")))).alias("opportunity_score"),
    )
