"""Secret scans: patterns, and a battery of randomness tests, by DataFrame functions alone.

The base patterns find assignments, access keys and hex strings. The battery looks
at other runs of token characters: it infers the encoding (the smallest alphabet
that holds the run), and tests the run against it three ways. The hypothesis to be
rejected is that the run is made of words. Words use an alphabet unevenly, so their
chi-squared statistic grows with their length; their number of runs above and below
the middle of the alphabet, and the serial correlation of neighbours, stray further
from what is expected of random letters than random letters do. Each test gives the
chance that words of this length look as random as the run does; Fisher's method
makes one p-value of the three. Which p-values count is decided by the
Benjamini-Hochberg rule within classes of encoding and length, as short runs are
many and tell little.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import matches

#: The kinds in the order in which equal starts are listed, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE = 12
# a run's first AKIA with 14 characters or more behind it, a whole run of 16 hex digits or more:
# the same matches as with + and a later check of the length
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
RANDOM = "[A-Za-z0-9+/_-]{20,}={0,2}"

#: Encodings from the smallest alphabet up: name, letters, and how much unevenness a character of words adds to chi-squared.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("digits", DIGITS, 0.6),
    ("HEX", DIGITS + "ABCDEF", 1.0),
    ("lower", LOWER, 0.8),
    ("upper", UPPER, 0.8),
    ("base32", UPPER + "234567", 1.1),
    ("base36", DIGITS + LOWER, 1.4),
    ("letters", UPPER + LOWER, 2.4),
    ("base62", UPPER + LOWER + DIGITS, 3.0),
    ("base64", UPPER + LOWER + DIGITS + "+/", 3.1),
    ("base64url", UPPER + LOWER + DIGITS + "-_", 3.1),
)
#: How far runs and serial correlation of words stray, in standard deviations of random letters.
SPREAD = 3.0
#: P-values are kept as steps of -log p: level l stands for exp(-l / LEVELS_PER_UNIT), rounded up.
LEVELS_PER_UNIT, TOP_LEVEL = 16, 1600
CLASSES = 32


#: The coefficients of a Chebyshev fit of the complementary error function, right to 1.2e-7 of its value in every tail.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def bound(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def phi(z: Column) -> Column:
    """The normal distribution function, to within 1.2e-7 of its value (of one less it, above 0)."""

    def tail(x: Column, t: Column) -> Column:
        sum_ = F.lit(0.0)
        for c in reversed(ERFC):
            sum_ = sum_ * t + c
        return t * F.exp(sum_ - x * x) / 2

    def both(z: Column) -> Column:
        x = F.abs(z) / math.sqrt(2)
        return bound(1 / (1 + x / 2), lambda t: F.when(z < 0, tail(x, t)).otherwise(1 - tail(x, t)))

    return bound(z, both)


def in_letters(run: Column, letters: str) -> Column:
    return F.length(F.translate(run, letters, "")) == 0


def encoding(run: Column) -> Column:
    """The number of the run's encoding; null if no encoding has all its characters."""
    out = F.lit(None).cast("int")
    for n in reversed(range(len(ENCODINGS))):
        out = F.when(in_letters(run, ENCODINGS[n][1]), F.lit(n)).otherwise(out)
    return out


def of_encoding(code: Column, values: list) -> Column:
    """The value of the run's encoding, of a list with one for each."""
    return F.get(F.array(*map(F.lit, values)), code)


def battery(body: Column, code: Column) -> Column:
    """The level of the p-value (see LEVELS_PER_UNIT) of a run, without padding, that has the encoding ``code``."""
    letters = of_encoding(code, [x for _, x, _ in ENCODINGS])
    halves = of_encoding(code, ["0" * (len(x) // 2) + "1" * (len(x) - len(x) // 2) for _, x, _ in ENCODINGS])
    k, n, noise = of_encoding(code, [float(len(x)) for _, x, _ in ENCODINGS]), F.length(body).cast("double"), of_encoding(code, [bias for _, _, bias in ENCODINGS]) * F.length(body)
    chars = F.split(body, "")
    times = lambda c: (F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + times(c) * times(c))
    even = phi((squares * k / n - n - (k - 1) - noise) / F.sqrt(2 * (k - 1) + 4 * noise))
    # runs above and below the middle of the alphabet: the number of changes is binomial for random letters
    half = F.call_function("translate", body, letters, halves)
    changes = n - F.length(F.regexp_replace(half, "(?<=0)1|(?<=1)0", "")).cast("double")
    runs_z = F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    # serial correlation of neighbouring letters' places in the alphabet
    at = F.transform(chars, lambda c: F.position(c, letters) - 1 - (k - 1) / 2)
    products = F.aggregate(F.zip_with(F.slice(at, 1, F.size(chars) - 1), F.slice(at, 2, F.size(chars)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    serial_z = F.abs(products) / ((k * k - 1) / 12 * F.sqrt(n - 1))
    # Fisher: minus twice the sum of the logarithms is chi-squared with six degrees of freedom
    minus_log = lambda p, least: -F.log(F.greatest(p, F.lit(least)))
    ps = F.array(minus_log(even, math.exp(-TOP_LEVEL / LEVELS_PER_UNIT)), *(minus_log(2 * phi(z / SPREAD) - 1, 0.01) for z in (runs_z, serial_z)))
    x = F.aggregate(ps, F.lit(0.0), lambda a, p: a + p, lambda x: x - F.log(1 + x + x * x / 2))
    return F.least(F.lit(TOP_LEVEL), F.greatest(F.lit(0), F.floor(x * LEVELS_PER_UNIT).cast("int")))


def base_spans(text: Column) -> Column:
    """``start``, ``rank`` (of the kind), ``end`` of the base patterns' matches, in order."""
    as_rank = lambda found, rank: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
    long_value = lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 2)) >= ASSIGN_VALUE
    always = lambda m: F.lit(True)
    return F.array_sort(F.concat(as_rank(matches(text, ASSIGN, long_value), 0), as_rank(matches(text, ACCESS, always), 1), as_rank(matches(text, HEX, always), 2)))


def tested_runs(text: Column) -> Column:
    """``start``, ``end``, ``level`` and ``test_class`` (of encoding and length) of the runs that the battery can test."""
    body = lambda x: F.rtrim(x["match"], F.lit("="))
    coded = F.transform(matches(text, RANDOM, lambda m: F.lit(True)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), body(x).alias("body"), encoding(body(x)).alias("code")))
    length_class = lambda x: F.least(F.lit(CLASSES - 1), F.floor(4 * F.log2(x["end"] - x["start"])).cast("int") - 16)
    tested = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["body"], x["code"]).alias("level"), (x["code"] * CLASSES + length_class(x)).alias("test_class"))
    return F.transform(F.filter(coded, lambda x: x["code"].isNotNull()), tested)


def least_levels(runs: DataFrame, rate: float) -> dict[int, int]:
    """For each class the least level whose runs count, by the Benjamini-Hochberg rule over all of ``runs`` (``test_class``, ``level``).

    What is gathered is a count for each class and level: as many numbers as there
    are encodings, CLASSES and levels at most.
    """
    counts = runs.groupBy("test_class", "level").agg(F.count("*").alias("n"))
    down = Window.partitionBy("test_class").orderBy(F.col("level").desc())
    ranked = counts.withColumns({"reached": F.sum("n").over(down), "tests": F.sum("n").over(Window.partitionBy("test_class"))})
    passing = ranked.where(F.exp(-F.col("level") / LEVELS_PER_UNIT) <= rate * F.col("reached") / F.col("tests"))
    return {r["test_class"]: r["level"] for r in passing.groupBy("test_class").agg(F.min("level").alias("level")).collect()}


def find_secrets(docs: DataFrame, text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, rank, end) by start, then kind.

    ``base`` has the patterns' matches, ``spans`` also the runs of 20 characters or
    more that the randomness battery takes for random at a false-discovery rate of
    ``rate`` and that overlap no base match. ``rank`` is a place in KINDS; starts and
    ends are code points. A null text counts as empty: no spans. Nothing depends on
    ids; repeated rows are treated alike; an empty table gives an empty result. The
    texts are read twice, once for the levels; nothing but their counts is shuffled.
    """
    runs = tested_runs(F.coalesce(F.col(text_col), F.lit("")))
    least = least_levels(docs.select(F.explode(runs).alias("r")).select("r.test_class", "r.level"), rate)
    found = docs.withColumn("base", base_spans(F.coalesce(F.col(text_col), F.lit(""))))
    if not least:
        return found.withColumn("spans", F.col("base"))
    floor = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
    found = found.withColumn("runs", F.filter(runs, lambda r: r["level"] >= floor[r["test_class"]]))
    alone = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    random = F.transform(alone, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("rank"), r["end"].alias("end")))
    return found.withColumn("spans", F.when(F.size("runs") > 0, F.array_sort(F.concat("base", random))).otherwise(F.col("base"))).drop("runs")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with ``mark`` in place of the spans; overlapping ones become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
