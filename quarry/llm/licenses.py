"""License scans by a positional index of rare words, with DataFrame functions alone.

One pass over the texts notes where license words stand. How many documents have
each word gives its rarity. All license words of a file that may vote are looked up
in the postings of the license templates, whatever else the file holds; where word and posting agree on where the
template would begin, they vote for that beginning. A template is reported if
enough rare words agree and one of its mandatory key phrases stands, word for word,
where that beginning puts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: What separates words (in lower-cased text), and the base phrases with their labels.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates: label, text, and key phrases (in the template's own words) of which one must be there.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2", ("gnu general public license as published by the free software foundation version 2",)),
    ("lgpl", "this library is licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    ("agpl", "this program is licensed under the gnu affero general public license version", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
)
#: Words too common to vote; they are noted only beside a license word, for the phrases.
COMMON = frozenset("a and any are as by can for free in is it not of or person that the this to under use with without work you may 0 2 3 4".split())
#: Agreeing words that a template needs.
AGREEING = 2


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def phrases() -> list[tuple[str, str, int, int]]:
    """(phrase, word, place in it, length) for every base and key phrase."""
    every = sorted({*BASE, *(k for _, _, keys in TEMPLATES for k in keys)})
    return [(p, w, k, len(p.split())) for p in every for k, w in enumerate(p.split())]


def postings() -> list[tuple[int, str, int]]:
    """(template, word, place) for every word of a template that may vote."""
    return [(t, w, q) for t, (_, text, _) in enumerate(TEMPLATES) for q, w in enumerate(text.split()) if w not in COMMON]


def key_places() -> list[tuple[int, str, int]]:
    """(template, key phrase, place of the phrase in it)."""
    out = []
    for t, (_, text, keys) in enumerate(TEMPLATES):
        ws = text.split()
        out += [(t, k, next(q for q in range(len(ws)) if ws[q : q + len(k.split())] == k.split())) for k in keys]
    return out


def noted(text: Column) -> tuple[Column, Column]:
    """How many words a text has, and ``pos``, ``word`` of those that the index or a phrase can use."""
    content = sorted({w for _, w, _ in postings()} | {w for _, w, _, _ in phrases()} - COMMON)
    common = sorted({w for _, w, _, _ in phrases()} & COMMON)
    w = words(text)
    near = lambda i: F.arrays_overlap(F.slice("words", F.greatest(i - 2, F.lit(0)) + 1, F.lit(6)), F.array(*map(F.lit, content)))
    useful = lambda x, i: x.isin(content) | (x.isin(common) & near(i))
    marked = F.transform("words", lambda x, i: F.when(useful(x, i), F.struct(i.alias("pos"), x.alias("word"))))
    return w, F.filter(marked, lambda x: x.isNotNull())


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The templates' own rows: their number is fixed by this module, so the side may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base_labels`` and ``labels`` are sorted arrays; ``labels`` has the templates'
    labels too. ``score`` is the best share of a reported template's rarity that was
    found (0 without one). A null or empty text has no word and no label; null ids
    and repeated rows are kept as rows of their own; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    w, hits = noted(F.col(text_col))
    files = docs.select(F.col(id_col).alias("i"), w.alias("words")).select("i", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    files = written(files.withColumn("uid", F.monotonically_increasing_id()))
    rows = files.select("uid", F.explode("hits").alias("h")).select("uid", F.col("h.pos").alias("pos"), F.col("h.word").alias("word"))

    # every place where all words of a phrase stand in order
    steps = small_table(spark, phrases(), "phrase string, word string, k int, length int")
    places = rows.join(steps, "word").groupBy("uid", "phrase", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("n"), F.first("length").alias("length"))
    places = written(places.where("n = length").select("uid", "phrase", "start"))
    base = places.join(small_table(spark, list(BASE.items()), "phrase string, label string"), "phrase")
    base = base.groupBy("uid").agg(F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.collect_set("label").alias("base_labels"))

    # rarity of license words over all documents: a row for each of a fixed list of words
    voting = sorted({w for _, w, _ in postings()})
    present = written(rows.where(F.col("word").isin(voting)).groupBy("uid", "word").agg(F.count("*").alias("n")).select("uid", "word"))
    total = files.count()
    rarity = present.groupBy("word").agg((F.log(F.lit(total + 1.0)) - F.log(F.count("*") + 0.0)).alias("idf"))
    known = {r["word"]: r["idf"] for r in rarity.collect()}
    highest = max(known.values(), default=1.0)
    idf = small_table(spark, [(w, known.get(w, highest)) for w in voting], "word string, idf double")
    mass = [(t, sum(known.get(w, highest) for w in {w for u, w, _ in postings() if u == t})) for t in range(len(TEMPLATES))]

    votes = rows.join(idf, "word").join(small_table(spark, postings(), "template int, word string, place int"), "word")
    begun = votes.groupBy("uid", "template", (F.col("pos") - F.col("place")).alias("begin")).agg(F.count("*").alias("agree"), F.sum("idf").alias("weight")).where(F.col("agree") >= AGREEING)
    keys = places.join(small_table(spark, key_places(), "template int, phrase string, place int"), "phrase").select("uid", "template", (F.col("start") - F.col("place")).alias("begin"))
    labels = small_table(spark, [(t, TEMPLATES[t][0], m) for t, m in mass], "template int, label string, mass double")
    method = begun.join(keys, ["uid", "template", "begin"], "left_semi").join(labels, "template")
    method = method.groupBy("uid").agg(F.collect_set("label").alias("method_labels"), F.max(F.least(F.lit(1.0), F.col("weight") / F.col("mass"))).alias("score"))

    none = F.array().cast("array<string>")
    out = files.select("uid", "i", "n_words").join(base, "uid", "left").join(method, "uid", "left")
    return out.select(
        F.col("i").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.sort_array(F.coalesce("base_labels", none)).alias("base_labels"),
        F.sort_array(F.array_distinct(F.concat(F.coalesce("base_labels", none), F.coalesce("method_labels", none)))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
