"""Quality rules: gradient-boosted trees over document statistics.

One pass over the texts takes each document's statistics. Trees are grown on those of
a bounded sample of labelled documents, with histograms, and with monotonic
constraints: a model may not rate a document higher because it has more symbols,
more repeats or more capitals. The trees are flattened into numpy node arrays, so a
batch of documents walks all of them level by level, without a branch in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_of_bytes, small_batches

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares that the trees see, and the direction in which each may move the score: -1 down, 0 either way.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "mark_share": -1,
    "digit_share": 0,
    "word_variety": 0,
    "top_word_share": -1,
    "mean_line": 0,
}
BLANK = np.zeros(len(BASE) + len(FEATURES))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more, the first finding included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1] if len(ids) >= 1 << 20 else code[:-1] * len(ids) + code[1:]
    window = pair[:-1].astype(np.int64) * len(ids) + code[2:]
    _, at, times = np.unique(window, return_inverse=True, return_counts=True)
    again = times[at] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def statistics(text: bytes) -> np.ndarray:
    """The base counts and the features of one text; a text without a word has zeros only."""
    words = text.split()
    n = len(words)
    if not n:
        return BLANK
    count = lambda letters: len(text) - len(text.translate(None, letters))
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    chars = points - count(SPACE)
    symbols = count(SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    upper = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return np.array([
        n, chars, symbols, dup, repeats,
        np.log1p(n), chars / n, symbols / chars, dup / len(lines), repeats / n, upper / chars,
        count(b"!?@^~_=+[]{}\\/") / chars, count(b"0123456789") / chars, len(distinct) / n, max(distinct.values()) / n, n / len(lines),
    ])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), forest: Forest | None = None) -> DataFrame:
    """``id_col``, ``carry``, the five base counts (longs) and ``features`` of every document.

    With a ``forest`` there is its score, ``quality``, in place of the features. A
    null text has no word. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    kept = [id_col, *(c for c in carry if c != text_col)]
    names = [f"k{n}" for n in range(len(kept))]
    last = ("features", "array<double>") if forest is None else ("quality", "double")
    text_too = text_col in carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of_bytes(batch, "t"):
                rows = np.array([statistics(t) if t else BLANK for t in part.column("t").to_pylist()])
                features = rows[:, len(BASE) :]
                if forest is None:
                    found = pa.ListArray.from_arrays(pa.array(np.arange(0, features.size + 1, features.shape[1]), pa.int32()), pa.array(features.ravel()))
                else:
                    found = pa.array(forest.scores(features))
                own = [*names, *(["t"] if text_too else [])]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in own), *(pa.array(rows[:, k].astype(np.int64)) for k in range(len(BASE))), found], [*own, *BASE, last[0]])

    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(kept, names)), F.col(text_col).cast("binary").alias("t"))
    schema = ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(names, kept)), *(["t binary"] if text_too else []), *(f"{b} long" for b in BASE), " ".join(last)])
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(kept, names)), *([F.col("t").cast("string").alias(text_col)] if text_too else []), *BASE, last[0])


@dataclass
class Forest:
    """Complete trees of one depth in flat arrays: split features, thresholds, leaf values."""

    depth: int
    base: float
    feature: np.ndarray  # trees x (2 ** depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2 ** depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The chance of the label 1 for every row."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, direction: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 2.0, least: int = 8) -> Forest:
    """Boosted trees for the labels ``y`` (0, 1) by second-order logistic gain.

    A split on a feature with a direction is taken only if its sides' values agree
    with it, and the sides' later values are held on their side of the middle.
    Without rows, or with one label only, the forest says how frequent the label is.
    """
    share = min(max((y.sum() + 1) / (len(y) + 2), 1e-3), 1 - 1e-3) if len(y) else 0.999
    base, nodes, leaves = float(np.log(share / (1 - share))), 2**depth - 1, 2**depth
    if len(y) < 2 * least or y.min() == y.max():
        return Forest(depth, base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
    wide = np.arange(x.shape[1]) * bins
    valid = np.array([[b < len(q) for b in range(bins)] for q in cuts])
    margin = np.full(len(y), base)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(leaves)
        members = [np.arange(len(y))]
        limits = [(-np.inf, np.inf)]
        for level in range(depth):
            nxt, nxt_limits = [], []
            for k, (rows, (lo, hi)) in enumerate(zip(members, limits)):
                node = 2**level - 1 + k
                flat = (code[rows] + wide).ravel()
                shape = (x.shape[1], bins)
                sums = [np.bincount(flat, np.repeat(v, x.shape[1]) if v is not None else None, x.shape[1] * bins).reshape(shape).cumsum(1) for v in (g[rows], h[rows], None)]
                gl, hl, nl = sums
                gt, ht = g[rows].sum(), h[rows].sum()
                vl = np.clip(-gl / (hl + ridge), lo, hi)
                vr = np.clip(-(gt - gl) / (ht - hl + ridge), lo, hi)
                worth = lambda s, q, v: -(s * v + 0.5 * (q + ridge) * v * v)
                v0 = np.clip(-gt / (ht + ridge), lo, hi)
                gain = worth(gl, hl, vl) + worth(gt - gl, ht - hl, vr) - worth(gt, ht, v0)
                fair = valid & (nl >= least) & (len(rows) - nl >= least) & ((vr - vl) * direction[:, None] >= 0)
                gain = np.where(fair, gain, 0)
                best = int(gain.argmax())
                f, b = divmod(best, bins)
                if gain[f, b] > 1e-6:
                    feature[node], threshold[node] = f, cuts[f][b]
                    left = code[rows, f] <= b
                    middle = (vl[f, b] + vr[f, b]) / 2
                    a, z = ((lo, middle), (middle, hi)) if direction[f] > 0 else ((middle, hi), (lo, middle)) if direction[f] < 0 else ((lo, hi), (lo, hi))
                    nxt += [rows[left], rows[~left]]
                    nxt_limits += [a, z]
                else:  # everything goes left
                    nxt += [rows, rows[:0]]
                    nxt_limits += [(lo, hi), (lo, hi)]
            members, limits = nxt, nxt_limits
        for k, (rows, (lo, hi)) in enumerate(zip(members, limits)):
            value[k] = rate * np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi)
            margin[rows] += value[k]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Forest(depth, base, np.array(out_f), np.array(out_t), np.array(out_v))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000, seed: int = 11) -> Forest:
    """A forest from the statistics of labelled documents, about ``most`` of them, twice as many at most.

    The sample is drawn by a hash of the id: with a chance that makes ``most`` rows
    likely, so that what is broadcast and what reaches the driver don't grow with the
    corpus. Statistics are taken of the sampled documents alone; rows that agree in
    id and statistics count once, and of a sample in which ids have many texts the
    first rows by a hash stay. Rows without an id are not trained on.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l")).agg(F.min(label_col).alias("y"))
    n = known.count()
    chance = F.pmod(F.xxhash64(F.lit(seed), "l"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, most / max(n, 1))))
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    stats = document_statistics(own.join(F.broadcast(known.where(chance)), F.col("i") == F.col("l")), "i", "t", ("y",)).select("i", "features", "y").distinct()
    sample = stats.orderBy(F.xxhash64(F.lit(seed), "i", "features")).limit(2 * most).toPandas()
    sample = sample.assign(first=sample["features"].map(tuple)).sort_values(["i", "first"], kind="stable")
    x = np.array(sample["features"].tolist(), dtype=np.float64).reshape(len(sample), len(FEATURES))
    return grow(x, sample["y"].to_numpy(dtype=np.float64), np.array(list(FEATURES.values())))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000, carry: tuple[str, ...] = (), keep_from: float = 0.5) -> DataFrame:
    """One row per document: id, ``carry``, base counts, ``quality`` (0 to 1), ``base_failed``, ``kept``.

    Documents that fail the base rules are never kept, others as the trees say. Null
    and empty texts have no word and fail. Null ids and repeated rows are kept; an
    empty table gives an empty result; without labels every document that passes the
    base rules is kept. Other columns are left out. Nothing is shuffled but the labels.
    """
    stats = document_statistics(docs, id_col, text_col, carry, fit(docs, labels, id_col, text_col, most=most))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "kept": ~failed & (F.col("quality") >= keep_from)})
