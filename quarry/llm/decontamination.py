"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

A mask names a few places of a window of words; the hash of the words there is a
seed, which words at the places left out can't change. With the three masks here,
any overlap of WINDOW words in which ALLOWED words are replaced still has a seed in
common, and so have the overlaps that shorter items ask for. Equal seeds say where
an item would lie in a document; there its words are compared with the document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Places of the words that each mask looks at.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 2, 6, 7), (0, 1, 2, 4, 5))
#: Words that an overlap spans (the whole item, if it is shorter), and the least length of an item.
WINDOW, LEAST_WORDS = 13, 8
#: Seeds of a benchmark up to which they are tested inside the documents' rows; beyond, seeds are joined.
MOST_INLINE = 200_000
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def allowed(window: Column) -> Column:
    """Replaced words that an overlap of ``window`` words may have: one in five."""
    return F.floor(window / 5).cast("int")


def word_array(text: Column) -> Column:
    """Words, A-Z lower-cased: runs of letters and digits, and of what isn't ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def seeds(codes: str, starts: Column) -> Column:
    """``hash`` and ``pos`` of each mask's seed at each start where all its words have codes."""
    of = lambda n, m: F.filter(
        F.transform(starts, lambda i: F.when(_all(F.get(codes, i + o).isNotNull() for o in m), F.struct(F.xxhash64(F.lit(n), *(F.get(codes, i + o) for o in m)).alias("hash"), i.alias("pos")))),
        lambda s: s.isNotNull(),
    )
    return F.flatten(F.array(*(of(n, m) for n, m in enumerate(MASKS))))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def starts(codes: str) -> Column:
    """Places of words with a code whose next word has one: all masks look at both."""
    places = F.transform(codes, lambda c, i: F.when(c.isNotNull() & F.get(codes, i + 1).isNotNull(), i))
    return F.filter(places, lambda i: i.isNotNull())


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``words`` (codes) of the items that are long enough."""
    codes = F.transform(word_array(F.col(text_col)), lambda w: F.xxhash64(w))
    return benchmark.select(F.col(id_col).alias("item"), codes.alias("words")).where(F.size("words") >= LEAST_WORDS)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most_inline: int = MOST_INLINE) -> DataFrame:
    """One row per document and benchmark item in it: id, item id, matched, item_words, first_word, last_word.

    An item is in a document if somewhere WINDOW words of it in a row (the whole item,
    if it has fewer) stand in the document with one word in five replaced at most.
    ``matched`` counts its words that agree at the best such place, ``first_word`` and
    ``last_word`` say which of the document's words overlaps span there. Items with
    fewer than LEAST_WORDS words, null texts among them, are passed over; null
    document texts have no words; null ids and repeated rows are searched each as a
    row of its own; equal item rows count once; an empty table gives an empty result.

    A benchmark of ``most_inline`` seeds or fewer goes into the plan as two sets, of
    its words and of its seeds, and only documents that have a seed leave their
    partition. A larger one is joined with the documents' seeds.
    """
    items = written(benchmark_items(benchmark, item_id, item_text).distinct())
    of_items = written(items.select("item", F.explode(seeds("words", starts("words"))).alias("s")).select("item", "s.hash", "s.pos").distinct())
    inline = of_items.count() <= most_inline
    rows = docs.select(F.col(id_col).alias("i"), word_array(F.col(text_col)).alias("w"))
    if inline:
        # both sets are bounded by most_inline: each seed brings a few words at most
        vocabulary = [r[0] for r in items.select(F.explode("words").alias("c")).distinct().collect()]
        known = [r[0] for r in of_items.select("hash").distinct().collect()]
        rows = rows.select("i", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
        rows = rows.select("i", F.transform("h", lambda h: F.when(h.isin(vocabulary), h)).alias("codes"))
        rows = rows.select("i", "codes", starts("codes").alias("at")).select("i", "codes", F.filter(seeds("codes", F.col("at")), lambda s: s["hash"].isin(known)).alias("seeds"))
        # the number, which no filter is pushed below, also keeps the arrays from being computed anew for each word
        rows = written(rows.withColumn("uid", F.monotonically_increasing_id()).where(F.size("seeds") > 0))
    else:
        rows = rows.select("i", F.transform("w", lambda w: F.xxhash64(w)).alias("codes")).withColumn("uid", F.monotonically_increasing_id())
        rows = written(rows.select("i", "codes", "uid", seeds("codes", starts("codes")).alias("seeds")))
    hits = rows.select("uid", F.explode("seeds").alias("s")).select("uid", "s.hash", F.col("s.pos").alias("at")).join(of_items, "hash")
    hits = hits.select("uid", "item", (F.col("at") - F.col("pos")).alias("shift")).distinct()

    pairs = hits.join(rows.select("uid", "i", "codes"), "uid").join(items.withColumnRenamed("item", "item2"), F.col("item").eqNullSafe(F.col("item2")))
    window = F.least(F.size("words"), F.lit(WINDOW))
    equal = F.transform("words", lambda w, q: F.when((F.col("shift") + q >= 0) & (F.get("codes", F.greatest(F.col("shift") + q, F.lit(0))) == w), 1).otherwise(0))
    judged = pairs.select("uid", "i", "item", "shift", F.size("words").alias("item_words"), window.alias("window"), equal.alias("equal"))
    sums = F.transform(F.sequence(F.lit(0), F.col("item_words") - F.col("window")), lambda s: F.aggregate(F.slice("equal", s + 1, F.col("window")), F.lit(0), lambda a, x: a + x))
    good = F.filter(F.transform(sums, lambda n, s: F.when(n >= F.col("window") - allowed(F.col("window")), s)), lambda s: s.isNotNull())
    judged = judged.withColumn("good", good).where(F.size("good") > 0)
    found = judged.select(
        "uid", "i", "item", "item_words", F.aggregate("equal", F.lit(0), lambda a, x: a + x).alias("matched"),
        F.greatest(F.lit(0), F.col("shift") + F.array_min("good")).alias("first_word"), (F.col("shift") + F.array_max("good") + F.col("window")).alias("last_word"),
    )
    best = F.max_by(F.struct("i", "matched", "item_words", "first_word", "last_word"), F.struct("matched", -F.col("first_word"), "last_word"))
    return found.groupBy("uid", "item").agg(best.alias("b")).select(F.col("b.i").alias(id_col), F.col("item").alias(item_id), "b.matched", "b.item_words", "b.first_word", (F.col("b.last_word") - 1).alias("last_word"))
