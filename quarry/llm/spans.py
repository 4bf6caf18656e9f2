"""Places of pattern matches in texts, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def _running(lengths: Column) -> Column:
    """For an array of numbers, the sum of those before each."""
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    return F.aggregate(lengths, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def running(lengths: Column) -> Column:
    """``_running`` in blocks: the arrays that grow element by element stay short."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    inside = F.transform(blocks, _running)
    return F.when(F.size(lengths) > 0, F.flatten(F.zip_with(inside, _running(sums), lambda xs, base: F.transform(xs, lambda x: x + base)))).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, keep) -> Column:
    """``start``, ``end`` (code points, end exclusive) and ``match`` of a pattern's matches that pass ``keep``.

    Matches are leftmost and don't overlap; the pattern must not match an empty
    string. Splitting the text by it gives what lies between matches, so starts are
    running sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.transform(found, lambda m, i: F.length(gaps[i]) + F.length(m))
    starts = F.zip_with(running(lengths), F.transform(found, lambda m, i: F.length(gaps[i])), lambda a, b: a + b)
    kind = "array<struct<start:int,end:int,match:string>>"
    all_of = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))
    return F.when(F.exists(found, keep), F.filter(all_of, lambda x: keep(x["match"]))).otherwise(F.array().cast(kind))
