"""Chat formatting by multi-party perspective rotation.

A conversation is rendered once for each of its speakers, with that speaker as the
assistant and the others as named users. A mask says which characters the assistant
speaks. A rendering comes in parts of BLOCK turn numbers, so that a conversation of
any length is never in one task as a whole; ordinary ones have one part. Parts are
numbered in order, and each knows where in the whole rendering it begins; where they
are cut depends on the turns alone, not on how the table is dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turn numbers that one part spans, and rows of it beyond which its turns become parts of their own.
BLOCK, MOST_ROWS = 256, 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, ASSISTANT, USER = "system", "assistant", "user name="


def plain(text: Column) -> Column:
    """A text or name without the markers themselves: a blank goes into each."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))


def parts(turns: DataFrame) -> DataFrame:
    """The different rows of ``turns`` with ``copies`` and ``part``: a struct that orders a conversation's parts, none of them with much over MOST_ROWS rows.

    A block with more rows than that is cut at turn numbers, and a turn number that
    alone has more (they repeat) by the place of its rows, speaker and text deciding,
    equal rows being one with a number of copies until then.
    """
    rows = turns.groupBy("conv", "turn", "speaker", "text").agg(F.count("*").alias("copies")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    counts = rows.groupBy("conv", "block", "turn").agg(F.sum("copies").alias("n"))
    full = counts.groupBy("conv", "block").agg(F.sum("n").alias("m")).where(F.col("m") > MOST_ROWS)
    full = counts.join(full.select(F.col("conv").alias("c"), F.col("block").alias("b")), F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).select(F.col("conv").alias("c"), F.col("turn").alias("t"), "n")
    full = written(full)
    whole = F.struct("block", F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("piece"))
    if full.isEmpty():
        return rows.withColumn("part", whole)
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    joined = rows.join(full, same, "left")
    cut = lambda piece: F.struct("block", "turn", piece.cast("long").alias("piece"))
    calm = joined.where(F.coalesce("n", F.lit(0)) <= MOST_ROWS).withColumn("part", F.when(F.col("n").isNull(), whole).otherwise(cut(F.lit(0)))).drop("c", "t", "n")
    reached = F.sum("copies").over(Window.partitionBy("conv", "turn").orderBy("speaker", "text"))
    crowded = joined.where(F.col("n") > MOST_ROWS).withColumn("from", reached - F.col("copies")).withColumn("to", F.col("from") + F.col("copies"))
    crowded = crowded.withColumn("p", F.explode(F.sequence(F.floor(F.col("from") / MOST_ROWS), F.floor((F.col("to") - 1) / MOST_ROWS))))
    inside = F.least("to", (F.col("p") + 1) * MOST_ROWS) - F.greatest("from", F.col("p") * MOST_ROWS)
    return calm.unionByName(crowded.withColumn("copies", inside).withColumn("part", cut(F.col("p"))).select(*calm.columns))


def perspectives(lines: DataFrame) -> DataFrame:
    """``c``, ``p`` (a conversation's part), ``me``, ``part_no`` and ``offset``, where the part begins in the rendering for ``me``: numbers only, no texts.

    Rendered for nobody, a part has a certain length; each turn of the assistant is
    shorter by what ``assistant`` saves against the user's name.
    """
    head = F.when(F.col("speaker") == SYSTEM, F.length(F.lit(SYSTEM))).otherwise(F.length("speaker") + len(USER))
    size = head + F.length("text") + len(OPEN) + len(CLOSE) + 2
    said = written(lines.groupBy("conv", "part", "speaker").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * size).alias("size")))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = said.groupBy("conv", "part").agg(F.sum("size").alias("size")).withColumns({"part_no": F.row_number().over(Window.partitionBy("conv").orderBy("part")) - 1, "start": F.coalesce(F.sum("size").over(before), F.lit(0))})
    speakers = said.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("c"), F.col("speaker").alias("me")).distinct()
    views = numbered.join(speakers, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "part", "me", "part_no", "start")
    own = said.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("speaker").alias("s"), "n")
    views = views.join(own, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("me") == F.col("s")), "left")
    mine = F.coalesce(F.sum("n").over(Window.partitionBy("conv", "me").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shorter = F.length("me") + len(USER) - len(ASSISTANT)
    return views.select(F.col("conv").alias("c"), F.col("part").alias("p"), "me", "part_no", (F.col("start") - mine * shorter).alias("offset"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, speaker and part: ids, speaker, part, n_turns, offset, text, mask.

    Turns come in order of their number (nulls first), ties by speaker and text. Each
    is the opening marker, the name line (``assistant``, ``system``, or
    ``user name=...``), the text and the closing marker. ``mask`` is an array of
    (start, end) in code points of this part's text: what the assistant says, closing
    marker included; ``offset`` is where the part begins in the whole rendering. The
    speaker ``system`` is no participant; a conversation that has no other gives no
    row. A null text is empty, a null speaker is named ``unknown``, a null
    conversation id is a conversation of its own; repeated rows are repeated turns; an
    empty table gives an empty result; other columns are left out. Markers inside
    texts and names are broken up by a blank.
    """
    name = F.when(F.col(speaker_col).isNull() | (F.trim(speaker_col) == ""), F.lit("unknown")).otherwise(plain(F.regexp_replace(F.col(speaker_col), "\\s+", " ")))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), name.alias("speaker"), plain(F.col(text_col)).alias("text"))
    lines = written(parts(rows))
    said = lines.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text", "copies"))).alias("turns"))
    said = said.withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["copies"].cast("int")))))
    views = said.join(perspectives(lines), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))

    def line(t: Column) -> Column:
        who = F.when(t["speaker"] == SYSTEM, F.lit(SYSTEM)).when(t["speaker"] == F.col("me"), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), t["speaker"]))
        head = F.concat(F.lit(OPEN), who, F.lit("\n"))
        body = F.concat(t["text"], F.lit(CLOSE))
        return F.struct(F.concat(head, body, F.lit("\n")).alias("text"), F.length(head).alias("head"), F.length(body).alias("body"), (t["speaker"] == F.col("me")).alias("mine"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["head"]
        span = F.array(F.struct(start.alias("start"), (start + x["body"]).alias("end")))
        return F.struct((start + x["body"] + 1).alias("at"), F.when(x["mine"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    views = views.withColumn("lines", F.transform("turns", line))
    return views.select(
        F.col("conv").alias(conv_col), F.col("me").alias("speaker"), F.col("part_no").alias("part"), F.size("lines").alias("n_turns"), "offset",
        F.array_join(F.transform("lines", lambda x: x["text"]), "").alias("text"), F.aggregate("lines", begin, add, lambda acc: acc["mask"]).alias("mask"),
    )
