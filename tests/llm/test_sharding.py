import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import queries, sharding


def check(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for shard, got in by.items():
        assert 0 <= shard < shards and sorted(r.slot for r in got) == list(range(len(got)))
    sizes = [sum(r.size for r in by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max((r.size for r in rows), default=0)


def test_query(spark, sf_dir, texts):
    rows = queries.op8_sampled_splitters(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
    check(rows, texts, 24)


def test_many_copies_are_cut(spark):
    docs = [(n, "the same text again" if n % 3 else f"text number {n}") for n in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = sharding.shard_by_bytes(df, 24).collect()
    assert len(rows) == 3000
    check(rows, dict(docs), 24)


def test_edge_rows(awkward, clashing, nothing):
    for df in (awkward, clashing):
        rows = sharding.shard_by_bytes(df, 24).collect()
        assert len(rows) == 14 and sorted(r["size"] for r in rows)[:2] == [8, 8]
        check(rows, {}, 24)
    assert sharding.shard_by_bytes(nothing, 24).count() == 0


def test_many_small_documents_get_splitters(spark):
    """A third of all rows are empty texts beside large ones: no range holds many times its share of the rows."""
    rows = 30_000
    small = F.col("id") % 3 == 0
    size = F.when(small, 8).otherwise(5000).cast("long")
    key = F.when(small, F.xxhash64("id").bitwiseAND(F.lit((1 << sharding.SALT_BITS) - 1))).otherwise(F.xxhash64("id"))
    keyed = spark.range(rows).select(size.alias("size"), key.alias("key")).cache()
    total = keyed.agg(F.sum("size")).first()[0]
    cuts = sharding.splitters(keyed, 200, rows, total, 7)
    counts, sizes = sharding.totals(sharding.with_range(keyed, cuts), len(cuts) + 1)
    assert counts.sum() == rows and counts.max() <= 6 * rows / 200 and sizes.max() <= 6 * total / 200
