import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import patricia

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All nodes of the trie, sequence by sequence."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda cs: hashlib.sha256(",".join(map(str, cs)).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(ends.get(k, []))) for k, m in members.items())


def built(df):
    out = patricia.prefix_trie(df, lambda c: c - F.pmod(c, F.lit(5)), lambda c: F.crc32(c.cast("string").cast("binary")) % 9)
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0], r[1]))


@pytest.fixture(params=["few", "many"])
def dealt(request, spark):
    """With many partitions, conversations and blocks are cut between tasks."""
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    if request.param == "many":
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nodes_equal_those_of_all_sequences(spark, dealt):
    random.seed(2)
    rows = [(c, t, random.choice(("user", "assistant", None)), random.choice(("a", "bé", "", None))) for c in range(60) for t in range(random.randrange(1, 7))]
    rows += [(c, t, "u", "same") for c in range(100, 130) for t in range(12)]  # one sequence for many
    rows += [(c, t, "u", f"{t % 7}" if t < 70 + c % 3 else f"{c}{t}") for c in (200, 201, 202, 203, 205) for t in range(110)]  # long ones that part late
    rows += [(300, n % 3, "u", str(n % 3)) for n in range(90)]  # repeated rows
    rows += [(7_000_001, None, "u", "x"), (7_000_001, 1, "u", "y"), (7_000_004, 1, "u", "z"), (None, 1, "u", "lost"), (401, 1, "u", "a\\U0001f600" * 3000)]
    df = spark.createDataFrame(random.sample(rows, len(rows)), SCHEMA).repartition(5)
    assert built(df) == brute(rows)


def test_one_conversation_fills_many_tasks(spark, dealt):
    rows = [(5, t, "u", f"{t % 3}") for t in range(2000)] + [(6, t, "u", f"{t % 3}") for t in range(50)]
    assert built(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_turnless_and_none(spark):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)
    rows = [(c, 1, "u", "gone"), (c, 2, "u", "gone")]
    assert built(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert built(spark.createDataFrame([], SCHEMA)) == []
    assert built(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)) == []


def test_clashing_columns(spark):
    rows = [(c, t, "u", str(t * (c % 2))) for c in range(6) for t in range(4)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", 4, "y") for r in rows], f"{SCHEMA}, c long, d long, k1 long, mid string, size long, edge string")
    assert built(df) == brute(rows)


def test_ids_of_a_crowded_end(spark, monkeypatch, dealt):
    rows = [(c, 1, 1) for c in range(700)] + [(1000 + c, 1, 2) for c in range(3)]
    got = {(r.k1, r.k2): r.ends_sha256 for r in patricia.id_digests(spark.createDataFrame(rows, "c long, k1 long, k2 long").repartition(4)).collect()}
    want = {k: hashlib.sha256(",".join(str(c) for c, *x in rows if tuple(x) == k).encode()).hexdigest() for k in ((1, 1), (1, 2))}
    assert got == want
