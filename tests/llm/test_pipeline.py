import corpus_pipeline
from quarry.llm import decontamination, quality, secrets


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    frames = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns
        frames.append({r.doc_id: r for r in kept.collect()})
    judged = {r.doc_id: r.kept for r in quality.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert frames[0].keys() == {i for i, k in judged.items() if k}
    texts = [r.text for r in frames[1].values()]
    assert len(set(texts)) == len(texts) and frames[1].keys() <= frames[0].keys()
    assert {before[i] for i in frames[0]} >= set(texts) and len(texts) > 0.6 * len(frames[0])
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontamination.find_overlaps(spark.createDataFrame([(r.doc_id, r.text) for r in frames[2].values()], "doc_id long, text string"), benchmark).count() == 0
    assert frames[3].keys() == frames[2].keys() and any(r.text != before[i] for i, r in frames[3].items())
    assert secrets.find_secrets(kept).where("size(base) > 0").count() == 0
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(frames[3])


def test_stages_on_edge_rows(spark, awkward, clashing, nothing, sf_dir, rows_of):
    """Nulls in any column, empty and very long texts, repeated rows, no rows, and columns with clashing names."""
    columns = list(corpus_pipeline.COLUMNS)
    rest = "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars"
    plain, wide, empty = (df.selectExpr("*", *rest) for df in (awkward, clashing, nothing))
    expected = {
        "quality_rules": lambda out: all(i == 9 or len((t or "").split()) >= 50 for i, t in out),
        "simhash_near_dedup": lambda out: len(out) == 9 and len({t for _, t in out if t and t.strip()}) == 8,
        "benchmark_decontamination": lambda out: len(out) == 14,
        "secret_scan": lambda out: len(out) == 14 and out.count((1, None)) == 1 and ("[secret]\" [secret] [secret]" in {t for i, t in out if i == 7}),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = rows_of(stage(spark, plain, sf_dir), "doc_id", "text")
        assert expected[name](out), name
        assert out == rows_of(stage(spark, wide, sf_dir), "doc_id", "text"), name
        found = stage(spark, empty, sf_dir)
        assert found.count() == 0 and found.columns == columns, name
    assert corpus_pipeline.pack(spark, wide, sf_dir).where("start = 0").count() == 14 and corpus_pipeline.pack(spark, empty, sf_dir).count() == 0


def test_a_leak_takes_its_own_row_only(spark, sf_dir):
    """Rows without an id, and two texts under one id, stand or fall by their own text."""
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, f"before it {passage} after it"), (None, "a clean text without an id"), (5, passage), (5, "a clean text under the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'x' source", "cast(0 as long) n_chars")
    assert sorted(r.text for r in corpus_pipeline.decontaminate(spark, docs, sf_dir).collect()) == ["a clean text under the same id", "a clean text without an id"]
