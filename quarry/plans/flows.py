"""Queries over chains of events: repeated requests, rate limits, the lives of sends.

Requests are events, keyed by their type or user; sends are twelve events in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import limits, replay
from ..sources.tables import table
from ..streaming import sends as lives
from .crm import pick, query, sql_pick

TTL = 600_000


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))


@query(
    f"""WITH folded AS (SELECT event_type, list_reduce(list({{'id': event_id, 'at': epoch_us(ts) // 1000}} ORDER BY ts, event_id), lambda a, x:
    CASE WHEN x.at - a.at >= {TTL} THEN {{'at': x.at, 'answer': x.id, 'out': list_append(a.out, {{'id': x.id, 'answer': x.id}})}} ELSE {{'at': a.at, 'answer': a.answer, 'out': list_append(a.out, {{'id': x.id, 'answer': a.answer}})}} END,
    {{'at': -1000000000000::BIGINT, 'answer': NULL::BIGINT, 'out': []::STRUCT(id BIGINT, answer BIGINT)[]}}).out AS o FROM events GROUP BY event_type)
  SELECT event_type, o.id AS event_id, o.answer, o.id <> o.answer AS replay FROM (SELECT event_type, unnest(o) AS o FROM folded)"""
)
def request_replay(spark, d):
    """Requests of one type within ten minutes get the first one's answer."""
    return replay.replayed(events(spark, d), ["event_type"], "at", "event_id", TTL).select("event_type", "event_id", "answer", "replay")


#: Requests that a user may have in a window of so many seconds.
LIMITS = {"ALL": (3, 86_400), "AUTH": (2, 100_000)}


@query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS limited, user_id, o.t AS second, o.n, o.allowed, o.n - o.allowed AS refused FROM (SELECT user_id, unnest(list_reduce(list({{'t': t, 'n': n}} ORDER BY t), lambda a, x:
      CASE WHEN a.last IS NULL OR (x.t - a.last) * {capacity} // {window} > 0 THEN {{'last': x.t, 'x': greatest(0, least({capacity}, a.x + coalesce((x.t - a.last) * {capacity} // {window}, 0)) - x.n), 'out': list_append(a.out, {{'t': x.t, 'n': x.n, 'allowed': least(x.n, {capacity}, a.x + coalesce((x.t - a.last) * {capacity} // {window}, 0))}})}}
      ELSE {{'last': a.last, 'x': greatest(0, a.x - x.n), 'out': list_append(a.out, {{'t': x.t, 'n': x.n, 'allowed': least(x.n, a.x)}})}} END,
      {{'last': NULL::BIGINT, 'x': {capacity}::BIGINT, 'out': []::STRUCT(t BIGINT, n BIGINT, allowed BIGINT)[]}}).out) AS o
      FROM (SELECT user_id, epoch_us(ts) // 1000000 AS t, count(*) AS n FROM events WHERE {where} GROUP BY 1, 2) GROUP BY user_id)"""
        for (name, (capacity, window)), where in zip(LIMITS.items(), ("true", "event_type IN ('signup', 'error')"))
    )
)
def rate_limits(spark, d):
    """What two buckets of a user, for all requests and for signing in, let through."""
    e = events(spark, d).withColumn("second", F.floor(F.col("at") / 1000))
    asked = {"ALL": e, "AUTH": e.where("event_type IN ('signup', 'error')")}
    out = [limits.token_buckets(asked[name].select("user_id", F.col("second").alias("t")), ["user_id"], "t", *limit).withColumn("limited", F.lit(name)) for name, limit in LIMITS.items()]
    return out[0].unionByName(out[1])


CODES = ("WHATSAPP_NOT_CONNECTED", "WHATSAPP_SERVICE_UNREACHABLE", "INVALID_TEXT", "ODD", "PROVIDER_NOT_FOUND", "WHATSAPP_NOT_CONNECTED", "WHATSAPP_AUTH_MISMATCH")
UNTIL = 1_706_745_600_000  # the first of February 2024


def send_events(e: DataFrame) -> DataFrame:
    """Events as those of sends; ``e`` as ``events`` gives it."""
    n, kind = F.col("event_id"), F.col("event_type")
    what = F.when(n % 12 == 0, "ENQUEUE").when(kind.isin("click", "view"), "CLAIM").when(kind == "purchase", "SENT").when(kind == "error", "FAILED").otherwise("ENQUEUE")
    return e.withColumns({"send_id": F.floor(n / 12), "seq": n, "kind": what, "code": F.when(what == "FAILED", pick(CODES, n))})


def _after(status: str, attempts: str, claimed: str, due: str, code: str, at: str = "x.t") -> str:
    return f"""{{'status': {status}, 'attempts': {attempts}, 'claimed': {claimed}, 'due': {due}, 'code': {code}, 'out': list_append(a.out, {{'t': {at}, 'status': {status}, 'attempts': {attempts}, 'due': {due}, 'code': {code}}})}}"""


_NO, _TEXT = "NULL::BIGINT", "NULL::VARCHAR"


@query(
    f"""WITH e AS (SELECT event_id // 12 AS send_id, event_id AS seq, epoch_us(ts) // 1000 AS t, CASE WHEN event_id % 12 = 0 THEN 'ENQUEUE' WHEN event_type IN ('click', 'view') THEN 'CLAIM' WHEN event_type = 'purchase' THEN 'SENT' WHEN event_type = 'error' THEN 'FAILED' ELSE 'ENQUEUE' END AS kind,
    {sql_pick(CODES, 'event_id')} AS code FROM events),
  ticks AS (SELECT send_id, t, seq, 1 AS turn, kind, code FROM e UNION ALL SELECT send_id, t, seq, 0, 'TICK', NULL FROM e UNION ALL SELECT DISTINCT send_id, {UNTIL}, 0, 2, 'TICK', NULL FROM e),
  folded AS (SELECT send_id, list_reduce(list({{'kind': kind, 'code': code, 't': t}} ORDER BY t, seq, turn), lambda a, x: CASE
    WHEN x.kind = 'TICK' AND a.status = 'SENDING' AND a.claimed + 600000 <= x.t THEN {_after("'DELIVERY_UNKNOWN'", 'a.attempts', 'a.claimed', _NO, "'STUCK_SENDING_RECOVERY'", 'a.claimed + 600000')}
    WHEN x.kind = 'ENQUEUE' AND a.status IS NULL THEN {_after("'QUEUED'", '0::BIGINT', _NO, _NO, _TEXT)}
    WHEN x.kind = 'CLAIM' AND a.status = 'QUEUED' AND (a.due IS NULL OR a.due <= x.t) THEN {_after("'SENDING'", 'a.attempts + 1', 'x.t', _NO, 'a.code')}
    WHEN x.kind = 'SENT' AND a.status = 'SENDING' THEN {_after("'SENT'", 'a.attempts', 'a.claimed', _NO, _TEXT)}
    WHEN x.kind = 'FAILED' AND a.status = 'SENDING' AND x.code LIKE 'WHATSAPP%' AND a.attempts < 5 THEN {_after("'QUEUED'", 'a.attempts', 'a.claimed', 'x.t + 60000 * (1 << a.attempts)', 'x.code')}
    WHEN x.kind = 'FAILED' AND a.status = 'SENDING' AND x.code <> 'ODD' THEN {_after("'FAILED'", 'a.attempts', 'a.claimed', _NO, 'x.code')}
    WHEN x.kind = 'FAILED' AND a.status = 'SENDING' THEN {_after("'DELIVERY_UNKNOWN'", 'a.attempts', 'a.claimed', _NO, 'x.code')} ELSE a END,
    {{'status': {_TEXT}, 'attempts': 0::BIGINT, 'claimed': {_NO}, 'due': {_NO}, 'code': {_TEXT}, 'out': []::STRUCT(t BIGINT, status VARCHAR, attempts BIGINT, due BIGINT, code VARCHAR)[]}}).out AS o FROM ticks GROUP BY send_id)
  SELECT send_id, o.t AS "at", o.status, o.attempts, o.due AS next_attempt_at, o.code FROM (SELECT send_id, unnest(o) AS o FROM folded)"""
)
def send_lives(spark, d):
    """Every change of every send: claims, results, retries, hangs."""
    return lives.fold_sends(send_events(events(spark, d)), UNTIL)
