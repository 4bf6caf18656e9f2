import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality, queries, toxicity


def base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_brute_force(spark, sf_dir, texts):
    for r in queries.op6_boosted_quality(spark, sf_dir).collect():
        n = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)


def test_quality_agrees_with_the_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op6_boosted_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "y"), "doc_id").collect()
    passed = [r for r in got if not r.base_failed]
    assert np.mean([r.kept == bool(r.y) for r in passed]) > 0.9
    assert np.mean([r.kept for r in passed if r.y]) > 0.95


def test_scores_are_monotonic_where_asked():
    rng = np.random.default_rng(3)
    x = rng.random((800, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(800) < 0.2)).astype(float)
    forest = quality.grow(x, y, np.array([-1, 0, 1]), trees=30)
    grid = np.linspace(0, 1, 60)
    for _ in range(40):
        row = np.tile(rng.random(3), (60, 1))
        down, up = row.copy(), row.copy()
        down[:, 0], up[:, 2] = grid, grid
        assert (np.diff(forest.scores(down)) <= 1e-12).all() and (np.diff(forest.scores(up)) >= -1e-12).all()


def test_quality_edge_rows(spark, awkward, clashing, nothing, rows_of):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    cols = ["doc_id", *quality.BASE, "base_failed", "kept"]
    out = rows_of(quality.quality_rules(awkward, labels), *cols)
    assert len(out) == 14 and [r for r in out if r[0] == 2] == [(2, 0, 0, 0, 0, 0, True, False)]
    assert out == rows_of(quality.quality_rules(clashing, labels), *cols)
    assert quality.quality_rules(nothing, labels).count() == 0
    assert quality.quality_rules(awkward, labels.limit(0), carry=("text",)).where("not base_failed and not kept").count() == 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.op1_nnpu_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.85


def test_toxicity_edge_rows(spark, awkward, clashing, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 1), (7, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for docs in (awkward, clashing):
        out = toxicity.toxicity(docs, docs, labels).collect()
        assert len(out) == 14 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(nothing, nothing, labels).count() == 0
    prior = toxicity.toxicity(awkward, awkward, labels.where("toxic = 0")).select(F.countDistinct("score")).first()[0]
    assert prior == 1


def test_training_rows_are_bounded_by_rows(spark):
    """500 rows without an id, 700 copies of one row, and an id with 300 texts: none of them widens the sample."""
    rows = [(None, f"without an id {n}") for n in range(500)] + [(7, "the same words again")] * 700 + [(8, f"another text {n} of one id") for n in range(300)] + [(100 + n, f"clean text number {n}") for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1), (8, 1), (None, 1), (101, 0)], "doc_id long, toxic int")
    sample, prior = toxicity.training_rows(docs, labels, "doc_id", "text", 20, 30, 5)
    got = sample.collect()
    assert None not in {r.i for r in got} and sum(r.i == 7 and r.positive for r in got) <= 1
    assert 0 < sum(r.positive for r in got) <= 40 and 0 < sum(r.unlabelled for r in got) <= 60
    everything = toxicity.training_rows(docs, labels, "doc_id", "text", 4000, 10_000, 5)[0].collect()
    assert len(everything) == 1 + 300 + 200 and abs(prior - 2.5 / 4) < 1e-12
    quality_labels = spark.createDataFrame([(7, 1), (8, 0), *((100 + n, n % 2) for n in range(200))], "doc_id long, quality int")
    seen = []
    grow = quality.grow
    quality.grow = lambda x, y, direction: seen.append(len(y)) or grow(x, y, direction)
    try:
        quality.fit(docs, quality_labels, most=20)
        quality.fit(docs, quality_labels, most=20_000)
    finally:
        quality.grow = grow
    assert seen[0] <= 40 and seen[1] <= 501


def test_nn_pu_equals_a_plain_version():
    """The same steps with dense rows and one loss at a time."""
    rng = np.random.default_rng(4)
    size, prior = 12, 0.3
    dense = [(rng.random((n, size)) < p).astype(float) for n, p in ((30, 0.5), (50, 0.2))]
    weight, bias = toxicity.nn_pu(*([np.flatnonzero(r) for r in x] for x in dense), size, prior, steps=120)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in dense)
    theta, m, v = np.append(np.zeros(size), -1.0), np.zeros(size + 1), np.zeros(size + 1)
    turned = 0
    for step in range(1, 121):
        sp, su = 1 / (1 + np.exp(-p @ theta)), 1 / (1 + np.exp(-u @ theta))
        negative = np.mean(-np.log(1 - su)) - prior * np.mean(-np.log(1 - sp))
        g_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        g = prior * (p.T @ (sp - 1)) / len(p) + g_negative if negative >= 0 else -g_negative
        turned += negative < 0
        g[:-1] += 1e-4 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(weight, theta[:-1], atol=1e-6) and abs(bias - theta[-1]) < 1e-6


def test_node_arrays_equal_a_plain_walk():
    rng = np.random.default_rng(6)
    x = rng.random((600, 4))
    y = ((x[:, 0] + x[:, 1] ** 2 > 0.9) ^ (rng.random(600) < 0.1)).astype(float)
    forest = quality.grow(x, y, np.array([0, 1, 0, 0]), trees=20)

    def walk(row):
        margin = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 if row[feature[node]] <= threshold[node] else 2 * node + 2
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(forest.scores(x[:100]), [walk(r) for r in x[:100]])


def test_kept_is_the_verdict_of_the_trees(spark, sf_dir):
    """``kept`` from whole tables against statistics and trees of single texts."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality_rules(docs, labels).collect():
        score = forest.scores(np.array([quality.statistics((texts[r.doc_id] or "").encode())])[:, len(quality.BASE) :])[0]
        assert r.kept == (not r.base_failed and score >= 0.5)
