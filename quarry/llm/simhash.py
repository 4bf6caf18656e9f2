"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint gets a code, a non-zero vector of radius + 1 bits. Each of
the 2 ** (radius + 1) - 1 tables belongs to a non-zero vector too and looks only at
the bits whose code has an odd product with it. The codes of the bits in which two
fingerprints differ, radius of them at most, span no more than radius dimensions,
so some table's vector has an even product with all of them: there the two agree.
No pair within the radius can be missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, runs_of_bytes, scope, small_batches, written
from .components import connected_components

BITS = 64
#: Bytes of text whose shingles a task holds at once.
RUN = 1 << 20
#: Buckets up to this many fingerprints are compared pair by pair, larger ones through shared neighbours.
SMALL_BUCKET = 16
#: Counters (least and most of them, as powers of two) in which all shingles of all texts are counted, and those that travel together.
COUNTERS, MOST_COUNTERS, CHUNK = 20, 24, 1 << 14
#: Radius of the covering tables over fingerprints of sets.
COVERED = 3
#: Members that a large bucket chooses in a round, and how many of those that its buckets chose a node is held against.
HUBS, TRIES = 4, 4
#: Members of a large bucket that are compared with the others as one block.
BLOCK = 256


def masks(radius: int) -> list[int]:
    """The tables' masks, as signed longs."""
    codes = [1 + i % ((1 << (radius + 1)) - 1) for i in range(BITS)]
    out = [sum(1 << i for i in range(BITS) if (codes[i] & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def votes(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of ragged groups of hashes: a bit is set if over half of the group's are."""
    out = np.zeros(len(ends), dtype=np.uint64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends - starts
    full = size > 0
    if not full.any():
        return out
    for bit in range(BITS):
        ones = np.add.reduceat(((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts[full], dtype=np.int64)
        out[full] |= (2 * ones > size[full]).astype(np.uint64) << np.uint64(bit)
    return out


def hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of ``words`` words, or of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxh64_intdigest(line, 42)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col`` and ``fingerprint`` (a long) of every document; without a word it is 0.

    A null text has no word. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of_bytes(batch, "t", RUN):
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(votes(*ragged(part.column("t").to_pylist(), words)).view(np.int64))], ["i", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"i {dict(docs.dtypes)[id_col]}, fingerprint long").withColumnRenamed("i", id_col)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    return np.unique(np.array(hashes(text, words) if text else [], np.uint64))


def shingle_counts(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """How many texts have the shingles of each counter, of all texts. A shingle's counter is named by the first bits of its hash.

    Shingles share counters; a counter is high if one of its shingles is common, as
    the others add much the same everywhere. The counts only set an order: no result
    hangs on them. A task sends its counters, of a fixed number, in chunks, which are
    added up before they reach the driver. There are about four counters a text,
    between the two bounds.
    """
    small_batches(docs.sparkSession)
    bits = min(MOST_COUNTERS, max(COUNTERS, docs.count().bit_length() + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in runs_of_bytes(batch, "t", RUN):
                for text in part.column("t").to_pylist():
                    np.add.at(counts, (shingle_set(text, words) >> np.uint64(64 - bits)).astype(np.int64), 1)
        some = [n for n in range(0, len(counts), CHUNK) if counts[n : n + CHUNK].any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(some, np.int64)), pa.array([counts[n : n + CHUNK].tobytes() for n in some], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[n] = sums.get(n, 0) + np.frombuffer(counts, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk long, counts binary"
    found = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros(1 << bits, np.uint32)
    for r in found.toLocalIterator():
        out[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.counts, np.uint32)
    return out


def prefixes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """``id``, ``key`` (a hash of the text), ``fp`` (a hash of the set of shingles), ``sim``, its fingerprint, ``n``, its size, and ``prefix`` of every document.

    With all sets in one order, those of low ``counts`` first, two sets of the similarity
    share one of the first ``n - ceil(similarity * n) + 1`` of each: the prefix. A
    task gives the prefix of equal sets once; later rows of them have an empty one.
    """
    from xxhash import xxh64_intdigest

    small_batches(docs.sparkSession)
    shift = np.uint64(64 - (len(counts).bit_length() - 1))

    def prefix(found: np.ndarray) -> np.ndarray:
        met = counts[(found >> shift).astype(np.int64)]
        first = len(found) - math.ceil(round(similarity * len(found), 9)) + 1 if len(found) else 0
        return found[np.lexsort((found, met))[:first]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for part in runs_of_bytes(batch, "t", RUN):
                sets = [shingle_set(t, words) for t in part.column("t").to_pylist()]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                sims = votes(np.concatenate(sets), np.cumsum(sizes))
                fps = [xxh64_intdigest(found.tobytes(), 42) for found in sets]
                firsts = []
                for fp, found in zip(fps, sets):
                    firsts.append(found[:0].view(np.int64) if fp in given else prefix(found))
                    given.add(fp)
                columns = [part.column("id"), part.column("key"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sims.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(firsts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "fp", "sim", "n", "prefix"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, key long, fp long, sim long, n int, prefix array<long>")


def shingle_sets(docs: DataFrame, text_col: str, words: int, carry: str) -> DataFrame:
    """``carry`` (a long) and ``shingles``, the different hashes of the text's shingles, of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of_bytes(batch, "t", RUN):
                sets = [shingle_set(t, words).view(np.int64) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(carry), pa.array(sets, pa.list_(pa.int64()))], [carry, "shingles"])

    return docs.select(carry, F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"{carry} long, shingles array<long>")


def judged_sets(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """``fp`` and ``shingles`` of the sets of the rows that ``wanted`` (``one``: id and hash of the text) names.

    A filter of these rows goes to the texts, so that only the sets asked for are
    made; a few others that the filter lets through do no harm. A task gives equal
    sets once.
    """
    from xxhash import xxh64_intdigest

    small_batches(docs.sparkSession)
    row = lambda id, key: F.xxhash64(id, key).alias("row")
    known = KeyFilter.of(wanted.select(row(F.col("one.id"), F.col("one.key"))), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            asked = batch.filter(pa.array(known.has(batch.column("row").to_numpy())))
            for part in runs_of_bytes(asked, "t", RUN):
                found = {xxh64_intdigest(x.tobytes(), 42): x.view(np.int64) for x in (shingle_set(t, words) for t in part.column("t").to_pylist())}
                found = {fp: x for fp, x in found.items() if fp not in given}
                given.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(list(found.values()), pa.list_(pa.int64()))], ["fp", "shingles"])

    rows = docs.select(row(F.col(id_col), F.xxhash64(text_col)), F.col(text_col).cast("binary").alias("t"))
    return written(rows.mapInArrow(run, "fp long, shingles array<long>"))


def ragged(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts in one array, and where each text's end."""
    found = [hashes(t, words) if t else [] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((h for hs in found for h in hs), np.uint64, int(sizes.sum())), np.cumsum(sizes)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bucketed(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` once for each table of the radius in which its bucket has company, with ``table``, ``bucket`` and ``n``, the bucket's size."""
    tables = F.explode(F.array(*(F.struct(F.lit(n).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for n, m in enumerate(masks(radius))))).alias("t")
    dealt = prints.select("node", "kind", "fp", "other", tables).select("node", "kind", "fp", "other", "t.table", "t.bucket")
    sizes = dealt.groupBy("kind", "table", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    return written(dealt.join(sizes, ["kind", "table", "bucket"]).select("node", "kind", "fp", "other", "table", "bucket", "n"))


def pairs_in_small(small: DataFrame, keys: list[str], columns: list[str], rule: Callable[[Column, Column], Column]) -> DataFrame:
    """``a``, ``b``: the pairs of nodes in each bucket of SMALL_BUCKET at most that ``rule``, for two structs of ``columns``, takes."""
    grouped = small.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("fps"))
    later = F.transform("fps", lambda a, i: F.transform(F.filter(F.slice("fps", i + 2, SMALL_BUCKET), lambda b: rule(a, b)), lambda b: F.struct(a["node"].alias("a"), b["node"].alias("b"))))
    return grouped.select(F.explode(F.flatten(later)).alias("p")).select("p.a", "p.b")


def links(prints: DataFrame, radius: int) -> DataFrame:
    """``a``, ``b``: links that join all nodes of ``prints`` (``node``, ``kind``, ``fp``, ``other``: longs) within ``radius`` bits.

    Only fingerprints of one kind meet. A table's small buckets give their pairs within the radius. The fingerprints
    of large buckets are not compared with one another but meet at values near them.
    """
    shared = bucketed(prints, radius)
    near = pairs_in_small(shared.where(F.col("n") <= SMALL_BUCKET), ["kind", "table", "bucket"], ["fp", "node", "other"], lambda a, b: distance(a["fp"], b["fp"]) <= radius)
    return near.unionByName(meetings(shared.where(F.col("n") > SMALL_BUCKET).select("node", "kind", "fp", "other").distinct(), radius))


def meetings(prints: DataFrame, radius: int) -> DataFrame:
    """The links among ``prints`` without comparing pairs.

    With k = radius // 2, every fingerprint names the values within k bits (inner)
    and, for an odd radius, those at k + 1 bits (outer). Two that differ in at most
    ``radius`` bits meet at a value, one of them as inner; and whoever meets an inner
    one at a value is within the radius of it. So the least inner one of each value
    is linked with all others there. A value has few different fingerprints: what
    lies within k + 1 bits of it, whatever the size of the bucket.
    """
    k, odd = divmod(radius, 2)
    flips = [sum(1 << b for b in bits) for n in range(k + odd + 1) for bits in combinations(range(BITS), n)]
    near = F.split(F.lit(",".join(str(v - (1 << BITS) if v >> (BITS - 1) else v) for v in flips)), ",").cast("array<long>")
    named = prints.select("kind", F.struct("node", "fp", "other").alias("own"), F.explode(near).alias("flip")).select("kind", "own", F.col("own.fp").bitwiseXOR(F.col("flip")).alias("value"), (F.bit_count("flip") <= k).alias("inner"))
    met = named.groupBy("kind", "value").agg(F.min(F.when(F.col("inner"), F.col("own"))).alias("a"), F.collect_set("own").alias("all")).where((F.size("all") > 1) & F.col("a").isNotNull())
    met = met.select("a", F.explode("all").alias("b"))
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).where("a <> b")


def grouped(prints: DataFrame, nodes: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """``prints`` with ``component_id``, the least id that the links in ``found`` reach."""
    labels = connected_components(found)
    of_node = written(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    # written one by one: then both sides of each join are dealt out by it alone, and a large component or a fingerprint with many copies can be split
    roots = written(of_node.groupBy("label").agg(F.min("least").alias("component_id")))
    component = written(of_node.join(roots, "label").select(F.col("fp").alias("fingerprint"), "component_id"))
    return prints.join(component, "fingerprint").select(id_col, "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (a long) and ``component_id``.

    Documents are linked if their fingerprints differ in ``radius`` bits or fewer;
    ``component_id`` is the smallest id that links reach, itself included. Texts
    without a word (null ones too) have fingerprint 0 and are linked like any other.
    Copies are one node of the graph, whatever their number. Null ids never are the
    smallest unless a component has no other; repeated rows are kept; an empty table
    gives an empty result; other columns are left out.
    """
    prints = written(fingerprints(docs, id_col, text_col, words))
    nodes = written(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("least")))
    found = links(nodes.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("other"), F.lit(0).alias("kind")), radius)
    return grouped(prints, nodes, found, id_col)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Like ``near_duplicates``, for the Jaccard similarity of sets of word shingles in place of a radius; ``fingerprint`` is a hash of the set.

    Exact: two documents share a component if and only if a chain of pairs of the
    similarity or more joins them. Covering tables over fingerprints of the sets name
    the nearest pairs. Pairs beyond their radius share a shingle of both prefixes (see
    ``prefixes``), so they meet in that shingle's bucket. Every link is confirmed by
    the sets. Small buckets are compared pair by pair. In a large one all are first
    held against one of it, then against another, and so on, as long as that joins
    components; then all pairs of it that no component joins yet are compared.
    Nulls, copies and repeated rows are as in ``near_duplicates``.
    """
    prints, component = similar_components(docs, id_col, text_col, words, similarity)
    return prints.join(component, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), F.col("one.id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay if one document of each component of ``similar_documents`` does, whole.

    It is the one with the smallest id, in a tie the one whose text has the smallest
    hash; documents without an id come last, and stay only in a component without
    another. Rows that agree in id and text count as one; which of them gives the
    other columns is not defined. A text without a word, null or empty, is like any
    other text without one. An empty table gives an empty result. Only rows of
    components with more than one row are moved.
    """
    prints, component = similar_components(docs, id_col, text_col, words, similarity)
    rows = prints.groupBy("fp").agg(F.count("*").alias("rows")).join(component, "fp")
    crowded = written(rows.groupBy("one").agg(F.sum("rows").alias("rows")).where("rows > 1").select(F.col("one.id").alias("one_id"), F.col("one.key").alias("one_key")))
    keys = prints.join(component.join(crowded, (F.col("one.id").eqNullSafe(F.col("one_id"))) & (F.col("one.key") == F.col("one_key")), "left_semi").select("fp"), "fp", "left_semi").select("key")
    known = KeyFilter.of(keys, "key")

    @F.pandas_udf("boolean")
    def asked(key: pd.Series) -> pd.Series:
        return pd.Series(known.has(key.to_numpy()))

    names = docs.columns
    flagged = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key")).withColumn("asked", asked("key"))
    # the filter may let through documents that are alone in their component: they are no component's one here
    alone = flagged.where("asked").join(written(keys.distinct()), "key", "left_anti")
    one = flagged.where("asked").join(crowded, F.col("id").eqNullSafe(F.col("one_id")) & (F.col("key") == F.col("one_key"))).dropDuplicates(["id", "key"])
    return flagged.where("not asked").select("row").unionByName(alone.select("row")).unionByName(one.select("row")).select("row.*")


def similar_components(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``id``, ``key``, ``fp`` of every row, and for every ``fp`` the ``one`` (``id``, ``key``) of its component."""
    with scope(docs.sparkSession):
        prints = written(prefixes(docs, id_col, text_col, words, similarity, shingle_counts(docs, text_col, words)))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
        nodes = written(prints.groupBy("fp").agg(first.alias("one"), F.first("sim").alias("sim"), F.first("n").alias("n")))
        near = covered_pairs(nodes, COVERED)
        shared = shared_shingles(prints)
        pairs = written(near.unionByName(pairs_of_small(shared, similarity)).distinct())
        judged = pairs.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(shared.where(F.col("size") > SMALL_BUCKET).select(F.col("node").alias("fp"))).distinct()
        sets = judged_sets(docs, id_col, text_col, words, nodes.join(judged, "fp", "left_semi").select("one"))
        labels = connected_components(similar_links(pairs, shared, sets, similarity))
        of_node = written(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "one", F.coalesce("label", "fp").alias("label")))
        # written one by one: then both sides of each join are dealt out by it alone, and a large component or a text with many copies can be split
        roots = written(of_node.groupBy("label").agg(F.min("one").alias("one")))
        component = written(of_node.select("fp", "label").join(roots, "label").select("fp", F.struct("one.id", "one.key").alias("one")), outer=True)
        return written(prints.select("id", "key", "fp"), outer=True), component


def covered_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """``a``, ``b``: nodes to compare because a covering table has their fingerprints (``sim``) in one bucket.

    Each fingerprint within the radius of the least one in its bucket is paired with
    it, and the nodes of one fingerprint with the least of them: a pair for each node
    and table at most.
    """
    prints = written(nodes.groupBy("sim").agg(F.min("fp").alias("least")))
    tables = F.explode(F.array(*(F.struct(F.lit(n).alias("table"), F.col("sim").bitwiseAND(F.lit(m)).alias("bucket")) for n, m in enumerate(masks(radius))))).alias("t")
    dealt = prints.select("sim", tables).select("sim", "t.table", "t.bucket")
    hubs = dealt.groupBy("table", "bucket").agg(F.min("sim").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = dealt.join(hubs, ["table", "bucket"]).where((F.col("sim") != F.col("hub")) & (distance(F.col("sim"), F.col("hub")) <= radius)).select("sim", "hub").distinct()
    far = met.join(prints, "sim").withColumnRenamed("least", "a").join(prints.select(F.col("sim").alias("hub"), F.col("least").alias("b")), "hub")
    same = nodes.join(prints, "sim").where(F.col("fp") != F.col("least")).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return far.select("a", "b").unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def shared_shingles(prints: DataFrame) -> DataFrame:
    """``s``, ``node``, ``n``, ``size``: the prefixes' shingles that more than one node has, with their number of nodes.

    Few shingles are in two prefixes. All are counted, and a filter of those met
    twice goes to the prefixes, so that only what may have company is dealt out with
    its node.
    """
    twice = prints.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("size")).where("size > 1").select("s")
    known = KeyFilter.of(twice, "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            stay = known.has(prefix.values.to_numpy()[prefix.offsets[0].as_py() : prefix.offsets[-1].as_py()])
            of = np.repeat(np.arange(batch.num_rows), np.diff(prefix.offsets.to_numpy()))[stay]
            s = prefix.flatten().to_numpy()[stay]
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column("fp").take(pa.array(of)), batch.column("n").take(pa.array(of))], ["s", "node", "n"])

    rows = written(prints.select("fp", "n", "prefix").where(F.size("prefix") > 0).mapInArrow(run, "s long, node long, n int").distinct())
    sizes = rows.groupBy("s").agg(F.count("*").alias("size")).where("size > 1")
    return written(rows.join(sizes, "s").select("s", "node", "n", "size"))


def can_reach(a: Column, b: Column, similarity: float) -> Column:
    """Whether two sets of ``n`` shingles can have the similarity: the smaller one may not be too small."""
    return F.least(a["n"], b["n"]) >= F.round(F.greatest(a["n"], b["n"]) * similarity, 6)


def enough(pairs: DataFrame, of: DataFrame, elsewhere: str, similarity: float) -> DataFrame:
    """``a``, ``b``: those of ``pairs`` (with ``common``, shingles they share in the buckets looked at) that can have the similarity.

    ``of`` has each node's ``n`` and, in the column ``elsewhere``, its shingles in
    other buckets: they can share as many there as the lesser number says. Beyond the
    first end of the two prefixes, no more can be common than one of the sets has
    after its own; so enough of the prefixes must be.
    """
    end = lambda x: of.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col(elsewhere).alias(f"more_{x}"))
    after = F.ceil(F.round(F.greatest("n_a", "n_b") * similarity, 9)) - 1
    reach = F.col("common") + F.least("more_a", "more_b") + after >= F.round((F.col("n_a") + F.col("n_b")) * similarity / (1 + similarity), 6)
    return pairs.join(end("a"), "a").join(end("b"), "b").where(reach).select("a", "b")


def bucket_numbers(shared: DataFrame) -> DataFrame:
    """``node``, ``n``, and its shingles in ``small`` and in ``large`` buckets."""
    large = F.col("size") > SMALL_BUCKET
    return written(shared.groupBy("node").agg(F.first("n").alias("n"), F.count(F.when(large, 1)).alias("large"), F.count(F.when(~large, 1)).alias("small")))


def pairs_of_small(shared: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: the pairs that meet in small buckets of ``shared`` and can have the similarity."""
    small = shared.where(F.col("size") <= SMALL_BUCKET)
    met = pairs_in_small(small, ["s"], ["node", "n"], lambda a, b: can_reach(a, b, similarity)).groupBy("a", "b").agg(F.count("*").alias("common"))
    return enough(met, bucket_numbers(shared), "large", similarity)


def similar_links(pairs: DataFrame, shared: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: links that join all nodes of the similarity in ``pairs``, those of small buckets, and the large ones of ``shared``.

    In a round every node of a large bucket with several components is held against
    TRIES others at most: those that its buckets choose most often. A bucket chooses
    HUBS members, first of all the one with the most shingles in large buckets, as
    the text that copies were made from has more of them than its copies. Rounds go
    on as long as they join much; what then is apart is compared pair by pair.
    """
    rule = lambda a, b: can_reach(a, b, similarity)
    confirmed = lambda pairs: written(alike(written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), sets, similarity).distinct())
    found = confirmed(pairs)
    numbers = bucket_numbers(shared)
    large = shared.where(F.col("size") > SMALL_BUCKET).join(numbers.select("node", "large"), "node").select("s", F.struct("node", "n").alias("own"), "large")
    first = connected_components(found)
    rows = large.join(first.withColumnRenamed("node", "of"), F.col("own.node") == F.col("of"), "left").select("s", "own", "large", F.coalesce("label", "own.node").alias("label"))
    turn, before = 0, None
    while True:
        # a bucket's rows go once they are all of one component
        rows = written(rows)
        parts = rows.groupBy("s", "label").agg(F.count("*").alias("k")).groupBy("s").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("inside")).where(F.col("n") * F.col("n") > F.col("inside"))
        parts = written(parts)
        members, apart = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("inside")), F.lit(0))).first()
        if not apart:
            return found
        live = rows.join(parts.select("s", "n"), "s")
        if apart <= 4 * members or before and apart > 0.8 * before:
            return found.unionByName(confirmed(blockwise(live, numbers, similarity)))
        before = apart
        orders = [F.struct(-F.col("large"), "own.node"), *(F.struct(F.xxhash64(F.lit(turn * HUBS + k), "own.node"), "own.node") for k in range(1, HUBS))]
        chosen = live.groupBy("s").agg(*(F.min_by(F.struct("own", "label"), o).alias(f"x{k}") for k, o in enumerate(orders))).select("s", F.array_distinct(F.array(*(f"x{k}" for k in range(HUBS)))).alias("hubs"))
        met = live.join(chosen, "s").select("own", "label", F.explode("hubs").alias("x")).where((F.col("label") != F.col("x.label")) & rule(F.col("x.own"), F.col("own")))
        met = met.groupBy(F.col("own.node").alias("a"), F.col("x.own.node").alias("b")).agg(F.count("*").alias("times"))
        best = F.slice(F.sort_array(F.collect_list(F.struct("times", "b")), asc=False), 1, TRIES)  # of a node's hubs, HUBS for each of its shingles at most
        stars = met.groupBy("a").agg(best.alias("best")).select("a", F.explode("best").alias("x")).select("a", F.col("x.b").alias("b"))
        fresh = confirmed(stars)
        # only components that the round joins are looked at: its links between their labels
        label_of = lambda x: rows.select(F.col("own.node").alias(x), F.col("label").alias(f"label_{x}")).distinct()
        joined = fresh.join(label_of("a"), "a").join(label_of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        into = connected_components(joined).select(F.col("node").alias("label"), F.col("label").alias("to"))
        rows = live.drop("n").join(into, "label", "left").select("s", "own", "large", F.coalesce("to", "label").alias("label"))
        found, turn = written(found.unionByName(fresh)), turn + 1


def blockwise(rows: DataFrame, numbers: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: the pairs of ``rows`` (``s``, ``own``, ``label``, ``n``: the bucket's size) with two labels that can have the similarity; BLOCK members at a time meet all others.

    Each row brings its node's shingles in these buckets, so that a pair comes out of
    the join once, at the least shingle it shares, and only if it shares enough (see
    ``enough``; two labels have no other large bucket in common).
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    every = rows.groupBy(F.col("own.node").alias("node")).agg(F.sort_array(F.collect_set("s")).alias("all")).join(numbers.select("node", F.col("n").alias("size"), "small"), "node")
    full = written(rows.select("s", F.col("own.node").alias("node"), "label", "n").join(every, "node").select("s", "label", "n", F.struct("node", F.col("size").alias("n"), "small", "all").alias("own")))
    one = full.select("s", F.pmod(F.xxhash64("own.node"), blocks).cast("int").alias("block"), F.col("own").alias("x"), F.col("label").alias("label_x"))
    all_ = full.select("s", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("own").alias("y"), F.col("label").alias("label_y"))
    x, y = F.col("x"), F.col("y")
    common = F.array_intersect("x.all", "y.all")
    after = F.ceil(F.round(F.greatest(x["n"], y["n"]) * similarity, 9)) - 1
    reach = F.size(common) + F.least(x["small"], y["small"]) + after >= F.round((x["n"] + y["n"]) * similarity / (1 + similarity), 6)
    met = one.join(all_, ["s", "block"]).where((x["node"] < y["node"]) & (F.col("label_x") != F.col("label_y")) & can_reach(x, y, similarity) & reach & (F.array_min(common) == F.col("s")))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def as_similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose ``sets`` (``fp``, ``shingles``) have the Jaccard similarity or more."""
    return alike(pairs, sets.groupBy("fp").agg(F.min("shingles").alias("shingles")), similarity)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``as_similar`` for sets of which each is there once, or a few times: then pairs are, too. Only sets of the pairs are moved."""
    known = KeyFilter.of(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp")

    @F.pandas_udf("boolean")
    def asked(fp: pd.Series) -> pd.Series:
        return pd.Series(known.has(fp.to_numpy()))

    own = sets.where(asked("fp"))
    end = lambda n: own.select(F.col("fp").alias(n), F.col("shingles").alias(f"of_{n}"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(end("a"), "a").join(end("b"), "b").where(common >= F.round(similarity * (F.size("of_a") + F.size("of_b") - common), 9)).select("a", "b")
