import random
import re

from quarry.llm import decontamination, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def overlaps(docs, items):
    out = {}
    for i, t in docs.items():
        d = words(t)
        for j, x in items.items():
            w = words(x)
            if len(w) < decontamination.LEAST_WORDS:
                continue
            size = min(len(w), decontamination.WINDOW)
            for shift in range(size - len(w), len(d) - size + 1):
                equal = [0 <= shift + q < len(d) and d[shift + q] == v for q, v in enumerate(w)]
                good = [s for s in range(len(w) - size + 1) if sum(equal[s : s + size]) >= size - size // 5]
                if good:
                    out[i, j] = max(out.get((i, j), 0), sum(equal))
    return out


def test_query_equals_brute_force(spark, sf_dir, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    some = dict(sorted(texts.items())[:200])
    got = {(r.doc_id, r.item_id): r.matched for r in queries.op7_spaced_seeds(spark, sf_dir).collect()}
    want = overlaps(some, items)
    assert {k: v for k, v in got.items() if k[0] in some} == want and want


def test_replaced_words_and_both_ways(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    items = {n: " ".join(rng.choices(vocabulary, k=rng.choice([8, 10, 13, 30]))) for n in range(30)}
    docs = {}
    for n in range(120):
        body, passage = rng.choices(vocabulary, k=80), items[n % 30].split()
        size = min(len(passage), 13)
        if n % 2:
            for k in rng.sample(range(size), size // 5):
                passage[k] = "other"
        docs[n] = " ".join([*body, *(passage if n % 4 < 2 or len(passage) <= 13 else passage[:13]), *body[:5]])
    d, b = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = overlaps(docs, items)
    assert len(want) >= 120
    for most in (decontamination.MOST_INLINE, 10):
        assert {(r.doc_id, r.item_id): r.matched for r in decontamination.find_overlaps(d, b, most_inline=most).collect()} == want


def test_edge_rows(spark, awkward, clashing, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short item"), (4, "under the apache license or the mit license"), (4, "under the apache license or the mit license"), (None, "long long long long long long long long long")], "item_id long, text string")
    for docs in (awkward, clashing):
        assert sorted({(r.doc_id, r.item_id) for r in decontamination.find_overlaps(docs, items).collect()}, key=repr) == [(8, 4), (9, None)]
    assert decontamination.find_overlaps(nothing, items).count() == 0
    assert decontamination.find_overlaps(awkward, items.limit(0)).count() == 0
