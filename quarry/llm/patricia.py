"""A prefix trie of conversations, built as a Patricia trie.

Conversations become sequences of node keys: hashes of their first turns. They are
cut at every BLOCK turns, so that no row grows with a conversation; blocks that
begin below one node are sorted, and only their branch points, their ends and the
leaves become points, with the turns between two points kept on the compressed
edge. Where a sorted run is cut between two tasks, all nodes along the cut become
points, so both sides know the same ones. Counts are summed over subtrees of the
compressed trie, pointers to ancestors doubling their reach in each round. Then
the nodes on edges come back, with sums from their place to the edge's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scope, small_batches, written

#: Turns of a block, and most first turns that a conversation takes from its base.
BLOCK, LENT = 32, 8
#: Keys are polynomials in TIMES modulo a prime of 127 bits.
PRIME, TIMES = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F
LOW = (1 << 64) - 1
#: Bytes of decimal ids that are hashed as one piece.
PIECE = 1 << 20


def halves(key: int) -> tuple[int, int]:
    """A key as two signed longs."""
    low = key & LOW
    return key >> 64, low - (1 << 64) if low >> 63 else low


def whole(high: int, low: int) -> int:
    return high << 64 | low & LOW


def prefix_keys(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (``c``, ``d1``, ``d2``, ``size``) by ``c`` and ``order``, with place ``d``, key ``k1``, ``k2``, the key before it ``p1``, ``p2`` and ``cum``, the sum of sizes so far.

    Rows are sorted by range, so that one conversation may fill many tasks. A task
    numbers and sums what it has and tells about its first and last conversation;
    what lies before its first one, in the tasks before it, is put in front
    afterwards. Two rows a task reach the driver.
    """
    spark = rows.sparkSession
    small_batches(spark)
    names = ["c", "task", "edge", "d", "k1", "k2", "p1", "p2", "size", "cum"]
    schema = "c long, task int, edge int, d long, k1 long, k2 long, p1 long, p2 long, size long, cum long"
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 7]
    as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, first = TaskContext.get().partitionId(), None, None
        d = key = cum = 0
        total = lambda: (now, task, 0, d, *halves(key), 0, 0, 0, cum)
        for batch in batches:
            out = []
            for c, a, b, size in zip(*(batch.column(x).to_pylist() for x in ("c", "d1", "d2", "size"))):
                if c != now:
                    if now is not None and first is None:
                        first = total()
                    now, d, key, cum = c, 0, 0, 0
                before, d, cum = key, d + 1, cum + size
                key = (key * TIMES + whole(a & LOW, b) + 1) % PRIME
                out.append((c, task, 0, d, *halves(key), *halves(before), size, cum))
            if out:
                yield as_batch(out)
        if now is not None:
            ends = [(total(), 3)] if first is None else [(first, 1), (total(), 2)]
            yield as_batch([(*x[:2], mark, *x[3:]) for x, mark in ends])

    ordered = rows.select("c", "d1", "d2", "size", *order).repartitionByRange("c", *order).sortWithinPartitions("c", *order)
    local = written(ordered.select("c", "d1", "d2", "size").mapInArrow(run, schema))
    lead: dict[int, tuple[int, int, int, int]] = {}  # of each task whose first conversation began before: conversation, turns, key and sum
    before: tuple[int, int, int, int] | None = None
    for r in local.where("edge > 0").orderBy("task", "edge").collect():
        own = (r.c, r.d, whole(r.k1, r.k2), r.cum)
        if r.edge != 2 and before and before[0] == r.c:
            lead[r.task] = before
            own = (r.c, before[1] + r.d, (before[2] * pow(TIMES, r.d, PRIME) + own[2]) % PRIME, before[3] + r.cum)
        before = own

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, task, edge, d, k1, k2, p1, p2, size, cum in zip(*(batch.column(x).to_pylist() for x in names)):
                _, turns, key, total = lead[task]
                to = lambda high, low, n: halves((key * pow(TIMES, n, PRIME) + whole(high, low)) % PRIME)
                out.append((c, task, edge, d + turns, *to(k1, k2, d), *to(p1, p2, d - 1), size, cum + total))
            if out:
                yield as_batch(out)

    rows = local.where("edge = 0")
    if not lead:
        return rows.drop("task", "edge")
    begun = spark.createDataFrame([(t, x[0]) for t, x in lead.items()], "t int, of long")
    late = (F.col("task") == F.col("t")) & (F.col("c") == F.col("of"))
    return rows.join(F.broadcast(begun), late, "left_anti").unionByName(rows.join(F.broadcast(begun), late, "left_semi").mapInArrow(shifted, schema)).drop("task", "edge")


def rebuilt(turns: DataFrame, base: Callable[[Column], Column], lent: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations, to be put in the order of ORDER, and all conversations (``c``).

    ``lent`` says how many first turns (LENT at most) a conversation takes from its
    ``base``; it keeps its own ones behind as many. The first turns of a conversation
    are found task by task before they meet, and the others by comparing with the
    last of them.
    """
    first = F.row_number().over(Window.partitionBy("c").orderBy("known", "turn", "role", "d1", "d2", "mid"))
    firsts = written(turns.withColumn("pos", first).where(F.col("pos") <= LENT))
    every = firsts.where("pos = 1").select("c")
    heads = every.select(F.col("c").alias("to"), base(F.col("c")).alias("c"), lent(F.col("c")).alias("h")).join(firsts, "c").where("pos <= h")
    heads = heads.select(F.col("to").alias("c"), F.lit(0).alias("part"), F.lit(True).alias("known"), F.col("pos").cast("long").alias("turn"), "role", "d1", "d2", "mid", "size")
    at = F.struct("known", "turn", "role", "d1", "d2", "mid")
    last = firsts.where(F.col("pos") == lent(F.col("c"))).select("c", at.alias("last"))
    tails = turns.join(last, "c", "left").where((lent(F.col("c")) == 0) | (at > F.col("last")))
    return heads.unionByName(tails.select("c", F.lit(1).alias("part"), "known", "turn", "role", "d1", "d2", "mid", "size")), every


ORDER = ["part", "known", "turn", "role", "d1", "d2", "mid"]


def points(segments: DataFrame) -> DataFrame:
    """The points of sorted ``segments`` (``s1``, ``s2``: the node above; ``depth`` of that; ``path``; ``keys``, ``sizes``, ``cums`` of their nodes).

    A point has its key ``k1``, ``k2``, its ``depth``, the point above it ``p1``,
    ``p2``, its turn's ``size``, ``cum``, and ``edge``, the sizes of the nodes between
    them from above. A segment's last node is a point, so is a node with two children.
    """
    small_batches(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # of nodes: key, size, cum, whether it is a point
        start, top, begun, out = None, 0, False, []

        def pop(to: int) -> None:
            above, edge = (stack[to - 1][0] if to else start), []
            for n, (key, size, cum, point) in enumerate(stack[to:], to + 1):
                if point:
                    out.append((*key, top + n, *above, size, cum, edge))
                    above, edge = key, []
                else:
                    edge.append(size)
            del stack[to:]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [*[pa.int64()] * 7, pa.list_(pa.int64())])], ["k1", "k2", "depth", "p1", "p2", "size", "cum", "edge"])
            out.clear()
            return batch

        for batch in batches:
            for s1, s2, depth, keys, sizes, cums in zip(*(batch.column(x).to_pylist() for x in ("s1", "s2", "depth", "keys", "sizes", "cums"))):
                path = [(k["k1"], k["k2"]) for k in keys]
                if (s1, s2) != start:
                    pop(0)
                    start, top = (s1, s2), depth
                same = 0
                while same < min(len(stack), len(path)) and stack[same][0] == path[same]:
                    same += 1
                if same < len(stack):
                    pop(same)
                    if same:
                        stack[same - 1][3] = True
                # all nodes of a task's first segment are points: the task before may have others below them
                stack += [[k, size, cum, not begun] for k, size, cum in zip(path[same:], sizes[same:], cums[same:])]
                stack[-1][3] = begun = True
            if out:
                yield flush()
        for node in stack:  # and so are those of its last one
            node[3] = True
        pop(0)
        if out:
            yield flush()

    order = ["s1", "s2", "path"]
    ordered = segments.repartitionByRange(*order).sortWithinPartitions(*order)
    found = ordered.drop("path").mapInArrow(run, "k1 long, k2 long, depth long, p1 long, p2 long, size long, cum long, edge array<long>")
    return found.dropDuplicates(["k1", "k2"])  # those along a cut come twice, and are alike


def subtree_sums(values: DataFrame, above: DataFrame) -> DataFrame:
    """``values`` (``k1``, ``k2``, ``least`` and numbers) with each point's least and sums over its subtree; ``above``: ``k1``, ``k2``, ``p1``, ``p2``."""
    numbers = [c for c in values.columns if c not in ("k1", "k2", "least")]
    sums, far = values, above
    while not far.isEmpty():
        given = far.join(sums, ["k1", "k2"]).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.min("least").alias("least2"), *(F.sum(c).alias(f"{c}2") for c in numbers))
        sums = written(sums.join(given, ["k1", "k2"], "left").select("k1", "k2", F.least("least", "least2").alias("least"), *((F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in numbers)))
        # nothing is above the root, which is above very many
        inner = far.where("p1 <> 0 or p2 <> 0")
        far = written(inner.join(far.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2")), ["p1", "p2"]).select("k1", "k2", F.col("q1").alias("p1"), F.col("q2").alias("p2")))
    return sums


def id_digests(ends: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``ends_sha256``: the SHA-256 of the ids ``c`` that end at a node, ascending, comma-joined.

    Ids are sorted by range, so that those of one node may fill many tasks, which
    make pieces of text of them. A node's pieces are hashed in order, one at a time:
    the digest of a text can't be put together from those of its pieces.
    """
    small_batches(ends.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size = None, [], 0
        done = lambda: (*now, ids[0], ",".join(map(str, ids)).encode())
        as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [*[pa.int64()] * 3, pa.binary()])], ["k1", "k2", "first", "piece"])
        for batch in batches:
            out = []
            for k1, k2, c in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "c"))):
                if now != (k1, k2) or size > PIECE:
                    if now is not None:
                        out.append(done())
                    now, ids, size = (k1, k2), [], 0
                ids.append(c)
                size += 20
            if out:
                yield as_batch(out)
        if now is not None:
            yield as_batch([done()])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text = None, None
        done = lambda: (*now, text.hexdigest())
        as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string()])], ["k1", "k2", "ends_sha256"])
        for batch in batches:
            out = []
            for k1, k2, piece in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "piece"))):
                if now == (k1, k2):
                    text.update(b"," + piece)
                    continue
                if now is not None:
                    out.append(done())
                now, text = (k1, k2), hashlib.sha256(piece)
            if out:
                yield as_batch(out)
        if now is not None:
            yield as_batch([done()])

    order = ["k1", "k2", "c"]
    made = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(pieces, "k1 long, k2 long, first long, piece binary")
    return made.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "piece").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, base: Callable[[Column], Column], lent: Callable[[Column], Column], conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns come in order of their number, nulls first, ties by role and then by a hash
    of the text. Each conversation c is rebuilt: the first ``lent(c)`` turns (LENT at
    most) of conversation ``base(c)``, all if it has fewer and none if there is no
    such conversation, then its own behind its first ``lent(c)``. A node is a sequence
    of a rebuilt conversation's first turns; ``conv_id`` is the smallest one that has
    it. A null role or text is empty. A row without a conversation's id belongs to
    none. Repeated rows are repeated turns. An empty table gives no node, not even a
    root; other columns are left out. Nodes are told apart by hashes of 127 bits.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    digest = lambda n: F.xxhash64(F.lit(n), role, text)
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), digest(1).alias("d1"), digest(2).alias("d2"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("mid"))
    with scope(turns.sparkSession):
        sequences, every = rebuilt(written(rows), base, lent)
        keyed = written(prefix_keys(sequences, ORDER))
        last = keyed.groupBy("c").agg(F.max(F.struct("d", "k1", "k2", "cum")).alias("x"))
        root = lambda c: F.coalesce(f"x.{c}", F.lit(0).cast("long")).alias(c)
        ends = written(every.join(last, "c", "left").select("c", *map(root, ("k1", "k2", "cum"))))
        cells = F.sort_array(F.collect_list(F.struct("d", "k1", "k2", "p1", "p2", "size", "cum")))
        blocks = keyed.groupBy("c", F.floor((F.col("d") - 1) / BLOCK)).agg(cells.alias("x")).select("x", F.element_at("x", -1).alias("end"))
        blocks = blocks.select("x", F.col("end.k1").alias("e1"), F.col("end.k2").alias("e2")).dropDuplicates(["e1", "e2"])  # equal ones are one
        each = lambda f: F.transform("x", f)
        segments = blocks.select(F.col("x")[0]["p1"].alias("s1"), F.col("x")[0]["p2"].alias("s2"), (F.col("x")[0]["d"] - 1).alias("depth"), each(lambda y: y["k2"]).alias("path"), each(lambda y: F.struct(y["k1"].alias("k1"), y["k2"].alias("k2"))).alias("keys"), each(lambda y: y["size"]).alias("sizes"), each(lambda y: y["cum"]).alias("cums"))
        no_edge = F.array().cast("array<long>")
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
        roots = every.limit(1).select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), none.alias("p1"), none.alias("p2"), zero.alias("size"), zero.alias("cum"), no_edge.alias("edge"))
        nodes = written(points(segments).unionByName(roots))
        here = ends.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.first("cum").alias("reach"))
        children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
        on_edge = F.aggregate("edge", zero, lambda a, x: a + x)
        nodes = written(nodes.join(children, ["k1", "k2"], "left").join(here, ["k1", "k2"], "left").withColumns({"n_children": F.coalesce("n_children", zero), "n": F.coalesce("n", zero), "on_edge": on_edge}))
        own = nodes.select("k1", "k2", "least", "n", (F.col("n_children") == 0).cast("long").alias("leaves"), (F.col("n") * F.coalesce("reach", zero)).alias("reached"), (F.col("size") + F.col("on_edge")).alias("once"))
        sums = subtree_sums(own, nodes.where("p1 is not null").select("k1", "k2", "p1", "p2"))
        # all bytes of the subtree's turns, each as often as conversations have it, less each once
        saved = F.col("reached") - F.col("n") * (F.col("cum") - F.col("size")) - (F.col("once") - F.col("on_edge"))
        full = written(nodes.drop("n", "least", "reach").join(sums, ["k1", "k2"]).withColumn("saved", saved))
        up = full.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("above"))
        full = full.join(up, ["p1", "p2"], "left").join(id_digests(ends), ["k1", "k2"], "left")
        m, nothing = F.size("edge"), F.sha2(F.lit(""), 256)
        below = lambda i: F.aggregate(F.slice("edge", i + 1, m), zero, lambda a, x: a + x)
        unary = lambda i: F.struct((F.col("depth") - m + i).alias("depth"), F.when(i == 0, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_children"), (F.col("saved") + (F.col("n") - 1) * below(i)).alias("saved_tokens"), nothing.alias("ends_sha256"))
        point = F.struct("depth", F.when(m > 0, F.col("least")).otherwise(F.col("above")).alias("parent_conv_id"), "n_children", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
        some = F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), unary))
        out = full.select("least", "n", "leaves", F.explode(F.concat(F.coalesce(some, F.array().cast("array<struct<depth:bigint,parent_conv_id:bigint,n_children:bigint,saved_tokens:bigint,ends_sha256:string>>")), F.array(point))).alias("x"))
        return written(out.select(F.col("least").alias("conv_id"), "x.depth", "x.parent_conv_id", F.col("n").alias("n_convs"), "x.n_children", F.col("leaves").alias("n_leaves"), "x.saved_tokens", "x.ends_sha256"), outer=True)
