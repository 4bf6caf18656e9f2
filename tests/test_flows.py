import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import limits, replay
from quarry.plans import flows
from quarry.sources import tables
from quarry.streaming import events, sends


def answers(rows, ttl):
    """(key, at, id) -> answer, request by request."""
    last, out = {}, {}
    for key, at, i in sorted((r for r in rows if None not in r[:2]), key=lambda r: (r[0], r[1], r[2])):
        if key not in last or at >= last[key][0] + ttl:
            last[key] = (at, i)
        out[i] = last[key][1]
    return out | {i: i for key, at, i in rows if None in (key, at)}


@pytest.mark.parametrize("ttl,span", [(1, 50), (7, 300), (600, 40_000), (50, 20)])
def test_replays_equal_a_walk(spark, ttl, span):
    random.seed(ttl)
    rows = [(random.choice("aaaab"), random.randrange(-span, span), n) for n in range(400)] + [(None, 3, 1000), ("a", None, 1001), ("z", 0, 1002)]
    df = spark.createDataFrame(rows, "k string, at long, id long")
    got = replay.replayed(df, ["k"], "at", "id", ttl).collect()
    assert {r.id: r.answer for r in got} == answers(rows, ttl) and len(got) == len(rows)
    assert all(r.replay == (r.answer != r.id) for r in got)
    assert replay.replayed(df.limit(0), ["k"], "at", "id", ttl).count() == 0


def bucket(seconds, capacity, window):
    left, last, out = capacity, None, {}
    for t in sorted(seconds):
        refill = (t - last) * capacity // window if last is not None else 0
        if refill > 0 or last is None:
            left, last = min(capacity, left + refill), t
        out[t] = min(left, seconds[t])
        left -= out[t]
    return out


@pytest.mark.parametrize("capacity,window,span", [(5, 60, 400), (200, 60, 3), (3, 1000, 200_000), (1, 1, 40)])
def test_token_buckets_equal_a_walk(spark, capacity, window, span):
    random.seed(capacity)
    rows = [(random.choice((1, 1, 1, 2, None)), random.randrange(span)) for _ in range(1500)]
    got = limits.token_buckets(spark.createDataFrame([*rows, (3, None)], "u long, t long"), ["u"], "t", capacity, window).collect()
    for u in (1, 2, None):
        count = {}
        for v, t in rows:
            if v == u:
                count[t] = count.get(t, 0) + 1
        assert {r.second: r.allowed for r in got if r.u == u} == bucket(count, capacity, window)
        assert {r.second: r.n for r in got if r.u == u} == count
    assert all(r.allowed + r.refused == r.n for r in got)


@pytest.mark.parametrize("capacity,window,span,rows_at_once", [(5, 60, 400, 7), (200, 60, 30, 1000), (3, 1000, 200_000, 50)])
def test_buckets_of_busy_keys(spark, monkeypatch, capacity, window, span, rows_at_once):
    monkeypatch.setattr(limits, "CHUNK", rows_at_once)
    monkeypatch.setattr(limits, "TIMES", 2)
    monkeypatch.setattr(limits, "LEAST", 1)
    random.seed(capacity + window)
    rows = [(random.choice(("a", "a", "a", "b", None)), random.choice((random.randrange(-span, span), random.randrange(span // 10 + 1))), random.choice((1, None))) for _ in range(1500)]
    df = spark.createDataFrame([*rows, ("rare", 3, 1), ("rare", None, 1)], "u string, t long, v long").repartition(3)
    got = limits.token_buckets(df, ["u", "v"], "t", capacity, window, most=100).collect()
    for key in {(u, v) for u, _, v in rows}:
        count = {}
        for u, t, v in rows:
            if (u, v) == key:
                count[t] = count.get(t, 0) + 1
        assert {r.second: (r.n, r.allowed) for r in got if (r.u, r.v) == key} == {t: (count[t], n) for t, n in bucket(count, capacity, window).items()}
    assert [(r.second, r.n, r.allowed) for r in got if r.u == "rare"] == [(3, 1, 1)]
    assert len(got) == len({(u, t, v) for u, t, v in rows}) + 1
    marks = {(r.u, r.t) for r in replay.accepted_times(df, ["u"], "t", window, most=100).collect()}
    want = set()
    for key in ("a", "b", None):
        last = None
        for t in sorted({t for u, t, _ in rows if u == key}):
            if last is None or t >= last + window:
                want.add((key, last := t))
    assert marks == want | {("rare", 3)}


def test_chains_are_not_written_hop_by_hop(spark, monkeypatch):
    written = []
    monkeypatch.setattr(tables, "written_at", lambda df, at=tables.written_at: written.append(df) or at(df))
    df = spark.range(5000).selectExpr("id % 2 AS k", "id * 3 AS t", "id")
    assert limits.token_buckets(df, ["k"], "t", 2, 60).count() == 5000 and len(written) <= 1
    assert replay.replayed(df, ["k"], "t", "id", 60).where("NOT replay").count() == 2 * 250 and len(written) <= 2


def test_buckets_in_a_stream(spark, tmp_path):
    rows = [(n % 3, n // 40, "AUTH" if n % 2 else "ALL") for n in range(4000)] + [(1, None, "ALL"), (1, 5, "OTHER")]
    df = spark.createDataFrame(rows, "user_id long, s long, limited string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.orderBy(F.rand(1)).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    caps = {"ALL": (4, 60), "AUTH": (2, 60)}
    got = {(r.user_id, r.limited): r.allowed for r in events.drained(events.rate_limited(stream, caps), "limited2", str(tmp_path / "c"), "update").collect()}
    want = {}
    for name, limit in caps.items():
        for r in limits.token_buckets(df.where(F.col("limited") == name).select("user_id", F.unix_seconds("ts").alias("t")), ["user_id"], "t", *limit).groupBy("user_id").agg(F.sum("allowed").alias("n")).collect():
            want[r.user_id, name] = r.n
    assert got == want


def test_steps_of_a_send():
    walk = lambda *steps: [(s.status, s.attempts, s.next_attempt_at, s.code) for s, _ in sends.changes(1, None, iter(steps))]
    assert walk(("CLAIM", None, 0), ("ENQUEUE", None, 1), ("ENQUEUE", None, 2), ("SENT", None, 3), ("CLAIM", None, 4), ("CLAIM", None, 5), ("SENT", None, 6), ("FAILED", "ODD", 7)) == [("QUEUED", 0, None, None), ("SENDING", 1, None, None), ("SENT", 1, None, None)]
    again = [x for n in range(1, 7) for x in (("CLAIM", None, n * 10**7), ("FAILED", "WHATSAPP_NOT_CONNECTED", n * 10**7 + 1))]
    got = walk(("ENQUEUE", None, 0), *again)
    assert [g[0] for g in got] == ["QUEUED"] + ["SENDING", "QUEUED"] * 4 + ["SENDING", "FAILED"]
    assert [g[2] - n * 10**7 - 1 for n, g in enumerate(got[2:-1:2], 1)] == [120_000, 240_000, 480_000, 960_000]
    assert walk(("ENQUEUE", None, 0), ("CLAIM", None, 1), ("FAILED", "WHATSAPP_NOT_CONNECTED", 2), ("CLAIM", None, 3))[-1][0] == "QUEUED"  # not due yet
    for code, status in (("INVALID_TEXT", "FAILED"), ("PROVIDER_NOT_FOUND", "FAILED"), ("ODD", "DELIVERY_UNKNOWN"), (None, "DELIVERY_UNKNOWN")):
        assert walk(("ENQUEUE", None, 0), ("CLAIM", None, 1), ("FAILED", code, 2))[-1][0] == status
    late = list(sends.changes(1, None, iter([("ENQUEUE", None, 0), ("CLAIM", None, 1), ("SENT", None, 600_001)])))
    assert late[-1][1] == (1, 600_001, "DELIVERY_UNKNOWN", 1, None, "STUCK_SENDING_RECOVERY")


def test_a_stream_of_sends_equals_the_fold(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = flows.send_events(flows.events(spark, sf_dir)).withColumn("ts", F.timestamp_millis("at")).select("send_id", "ts", "at", "seq", "kind", "code")
    rows = rows.where("send_id < 25").unionByName(rows.orderBy(F.desc("at")).limit(1).select(F.lit(10**6).cast("long").alias("send_id"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"), "at", "seq", F.lit("CLAIM").alias("kind"), "code"))
    parts = [rows.where(f"send_id % 1000000 <> 0 and seq % 300 >= {lo} and seq % 300 < {lo + 100} or {lo} = 200 and send_id = 1000000 or {lo} = 0 and send_id = 0") for lo in (0, 100, 200)]
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in events.drained(sends.send_changes(stream), "sends", str(tmp_path / "c")).collect()}
    want = {tuple(r) for r in sends.fold_sends(rows.where("send_id < 1000000"), 1 << 60).collect()}
    assert len(want) > 40 and any(r[2] == "DELIVERY_UNKNOWN" and r[5] == "STUCK_SENDING_RECOVERY" for r in want)
    assert got == want
    assert sends.fold_sends(rows.limit(0)).count() == 0
