"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic texts and unlabelled texts, no confirmed clean
ones. Its risk is that of the positives, weighted by the class prior, plus that of
the unlabelled texts as if they were negative, less the part of it which positives
among them cause; this last difference can't be negative for a true risk, and when
training drives it below zero, the step goes the other way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, runs_of_bytes, small_batches, written

#: Every ASCII byte that is no letter or digit separates words; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Lengths, in characters, of the word beginnings that are features beside the word itself.
BEGINNINGS = range(3, 9)
KEPT_WORDS = 250_000


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(FOLD).split())


def marks(word: bytes) -> list[str]:
    """The features that a word is evidence of: itself (with an end mark) and its beginnings."""
    w = word.decode("utf-8", "replace")
    return [f"{w}$", *(w[:k] for k in BEGINNINGS if k <= len(w))]


class Model:
    """A linear classifier over which features a text has."""

    def __init__(self, features: list[str], weight: np.ndarray, bias: float):
        self.at = {f: n for n, f in enumerate(features)}
        self.weight, self.bias = weight, bias
        self.cache = TwoGenerations(self.places, KEPT_WORDS)

    def __reduce__(self):
        return Model, (list(self.at), self.weight, self.bias)

    def places(self, words: list[bytes]) -> list[tuple[int, ...]]:
        return [tuple(self.at[m] for m in marks(w) if m in self.at) for w in words]

    def rows(self, texts: list[bytes]) -> list[list[int]]:
        """Each text's features, by number and without repeats."""
        sets = [words_of(t) for t in texts]
        known = self.cache.load(set().union(*sets) if sets else set())
        return [sorted(set().union(*filter(None, map(known.__getitem__, s)))) for s in sets]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1 for each text; an empty one gets the bias alone."""
        margin = np.array([self.weight[r].sum() for r in self.rows(texts)], dtype=np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def nn_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, start: float = -1.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss (Adam, full batches)."""

    def sparse(rows: list[np.ndarray]):
        col = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), col, len(rows)

    def margins(x, w, b):
        row, col, n = x
        return np.bincount(row, w[col], n) + b

    def gradient(x, slope):  # of the mean loss
        row, col, n = x
        return np.append(np.bincount(col, slope[row], size), slope.sum()) / n

    p, u = sparse(positive), sparse(unlabelled)
    theta = np.append(np.zeros(size), start)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        zp, zu = margins(p, w, b), margins(u, w, b)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = gradient(u, su) - prior * gradient(p, sp)
        g = prior * gradient(p, sp - 1) + g_negative if as_negative >= 0 else -g_negative
        g[:-1] += decay * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_positive: int, most_unlabelled: int, seed: int) -> tuple[DataFrame, float]:
    """Sampled rows (``i``, ``t``, ``positive``, ``unlabelled``), and the class prior.

    Confirmed toxic rows are drawn from ``labels``, unlabelled ones from all of
    ``docs`` whatever their label. A hash of id and text decides, so that rows with
    an id and a text in common are drawn together; they become one. Rows without an
    id are left out. The chance makes about ``most_positive`` and ``most_unlabelled``
    rows likely, and never more than twice as many stay: the first by the hash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l")).agg(F.max("toxic").alias("toxic"))
    labelled, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    own = own.withColumn("h", F.xxhash64(F.lit(seed), "i", "t"))
    rows = own.count()
    drawn = lambda c, n, most: F.pmod(c, F.lit(1 << 24)) < F.lit(int((1 << 24) * min(1.0, most / max(n, 1))))
    # most_positive ids at most on average, so the side that is broadcast is bounded
    positive = F.broadcast(known.where((F.col("toxic") == 1) & drawn(F.xxhash64(F.lit(seed), "l"), toxic, most_positive)).select("l"))
    unlabelled = drawn(F.col("h"), rows, most_unlabelled)
    picked = own.join(positive, F.col("i") == F.col("l"), "left").where(F.col("l").isNotNull() | unlabelled)
    picked = picked.groupBy("i", "h").agg(F.first("t").alias("t"), F.first(F.col("l").isNotNull()).alias("positive"), F.first(unlabelled).alias("unlabelled"))
    picked = written(picked)
    # one id may have any number of texts: what is trained on is held to a number of rows
    last = lambda flag, most: picked.where(flag).orderBy("h").select("h").offset(most).limit(1).first()
    for flag, most in (("positive", most_positive), ("unlabelled", most_unlabelled)):
        if (end := last(flag, 2 * most)) is not None:
            picked = picked.withColumn(flag, F.col(flag) & (F.col("h") < F.lit(end["h"])))
    return picked.where("positive or unlabelled").select("i", "t", "positive", "unlabelled"), (toxic + 0.5) / (labelled + 1)


def feature_counts(rows: DataFrame) -> DataFrame:
    """``feature``, ``p`` and ``u``: the sampled positives and unlabelled rows that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, u = Counter(), Counter()
        for batch in batches:
            for text, positive, unlabelled in zip(*(batch.column(c).to_pylist() for c in ("t", "positive", "unlabelled"))):
                found = {m for w in words_of(text or b"") for m in marks(w)}
                if positive:
                    p.update(found)
                if unlabelled:
                    u.update(found)
            if len(p) + len(u) > 500_000:
                yield out(p, u)
                p, u = Counter(), Counter()
        yield out(p, u)

    def out(p: Counter, u: Counter) -> pa.RecordBatch:
        both = list(p.keys() | u.keys())
        return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([p[f] for f in both], pa.int64()), pa.array([u[f] for f in both], pa.int64())], ["feature", "p", "u"])

    return rows.mapInArrow(run, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_positive: int = 4_000, most_unlabelled: int = 10_000, features: int = 400, seed: int = 5) -> Model:
    """A model from confirmed toxic rows of ``labels`` and unlabelled rows of ``docs``.

    It has the ``features`` words and word beginnings that set positives apart most
    surely, among those that five positives or more have; only they, and which of
    them each sampled row has, reach the driver.
    """
    rows, prior = training_rows(docs, labels, id_col, text_col, most_positive, most_unlabelled, seed)
    positives, unlabelled = rows.agg(F.count_if("positive"), F.count_if("unlabelled")).first()
    if not positives or not unlabelled:
        return Model([], np.zeros(0), float(np.log(prior / (1 - prior))))
    # copies of one text under several ids have one label: how sure a difference is counts texts, not copies
    distinct = rows.groupBy(F.xxhash64("t").alias("h")).agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"), F.first("t").alias("t"))
    share = (F.col("p") + F.col("u") + 1) / (positives + unlabelled + 2)
    sure = (F.col("p") / positives - F.col("u") / unlabelled) / F.sqrt(share * (1 - share) * (1 / positives + 1 / unlabelled))
    best = feature_counts(distinct).where((F.col("p") >= min(5, positives)) & (sure > 3)).orderBy(sure.desc(), "feature").limit(features).toPandas()["feature"]
    model = Model(list(best), np.zeros(len(best)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.rows([t or b"" for t in batch.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("positive"), batch.column("unlabelled"), pa.array(found, pa.list_(pa.int32()))], ["i", "positive", "unlabelled", "found"])

    kind = dict(docs.dtypes)[id_col]
    sample = rows.mapInArrow(run, f"i {kind}, positive boolean, unlabelled boolean, found array<int>").orderBy("i").toPandas()
    found = [np.asarray(w, dtype=np.int64) for w in sample["found"]]
    pick = lambda flag: [w for w, f in zip(found, sample[flag]) if f]
    weight, bias = nn_pu(pick("positive"), pick("unlabelled"), len(best), prior)
    return Model(list(best), weight, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` for every whole text; a null one is empty. Nothing is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of_bytes(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(model.scores([t or b"" for t in part.column("t").to_pylist()]))], ["i", "score"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"i {dict(docs.dtypes)[id_col]}, score double").withColumnRenamed("i", id_col)


def toxicity(docs: DataFrame, train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` and ``predicted`` for all of ``docs``, learnt from ``train`` and ``labels``.

    Null and empty texts get the score of a text without a telling word; null ids are
    scored but never trained on; repeated rows are scored each and count once in
    training; an empty table gives an empty result; without a toxic label the score
    is the class prior.
    """
    return score(docs, fit(train, labels, id_col, text_col), id_col, text_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
