import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, components, queries, simhash


def fingerprint(text, words=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components_of(prints, radius):
    root = {p: p for p in set(prints.values())}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(list(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    least = {}
    for i, p in prints.items():
        least[find(p)] = min(i, least.get(find(p), i))
    return {i: least[find(p)] for i, p in prints.items()}


def test_every_pair_within_the_radius_shares_a_bucket():
    for radius in (1, 2, 3, 4, 5):
        masks = simhash.masks(radius)
        for bits in combinations(range(64), radius) if radius < 3 else (random.Random(n).sample(range(64), radius) for n in range(3000)):
            x = sum(1 << b for b in bits)
            assert any(x & (m & (1 << 64) - 1) == 0 for m in masks)


def test_query_equals_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op9_simhash_covering(spark, sf_dir).collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == components_of(prints, 2)


def test_links_in_large_buckets(spark):
    """A few hundred fingerprints around three centres fill buckets far beyond the small ones."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = {n: rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for n in range(500)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = spark.createDataFrame([(signed(p),) for p in set(prints.values())], "fp long").select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("other"), F.lit(0).alias("kind"))
    for radius in (1, 2, 3):
        label = {r.node: r.label for r in components.connected_components(simhash.links(distinct, radius)).collect()}
        want = components_of(prints, radius)
        groups = {}
        for n, p in prints.items():
            groups.setdefault(label.get(signed(p), signed(p)), set()).add(want[n])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame([*edges, (None, 7), (8, None)], "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in (300, 301, 302)}) == 1 and got[0] != got[300]


def test_edge_rows(awkward, clashing, nothing, rows_of):
    out = rows_of(simhash.near_duplicates(awkward), "doc_id", "component_id")
    assert len(out) == 14
    assert [c for i, c in out if i in (1, 2, 3)] == [1, 1, 1] and [c for i, c in out if i in (4, 5)] == [4, 4, 4]
    assert out == rows_of(simhash.near_duplicates(clashing), "doc_id", "component_id")
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.similar_documents(nothing).count() == 0


def test_similar_documents(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    docs, groups = [], []
    for n in range(60):
        words = rng.choices(vocabulary, k=220)
        copies = [words]
        for _ in range(2):
            w = list(words)
            w[rng.randrange(len(w))] = "changed"
            copies.append(w)
        groups += [n] * 3
        docs += [" ".join(w) for w in copies]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    joined = sum(len({got[i] for i in range(3 * n, 3 * n + 3)}) == 1 for n in range(60))
    assert joined >= 57
    assert all(groups[i] == groups[c] for i, c in got.items())


def test_similar_documents_equals_brute_force(spark):
    """Copies with one to twelve words replaced, on both sides of the similarity asked for."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    docs = []
    for n in range(80):
        words = rng.choices(vocabulary, k=240)
        docs.append(words)
        docs.append(list(words))
        for _ in range(1 + n % 12):
            docs[-1][rng.randrange(240)] = "changed"
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs]
    alike = {n: len(sets[2 * n] & sets[2 * n + 1]) / len(sets[2 * n] | sets[2 * n + 1]) for n in range(80)}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()}
    joined = {n for n in range(80) if got[2 * n] == got[2 * n + 1]}
    assert not {n for n in joined if alike[n] < 0.77}
    want = {n for n in range(80) if alike[n] >= 0.8}
    assert len(want & joined) >= 0.9 * len(want)
    assert len(set(got.values())) == 160 - len(joined)


def test_pairs_are_held_against_their_sets(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 4, 5]), (3, [1, 2, 3, 9]), (4, []), (2, [1, 2, 3, 4, 5])], "fp long, shingles array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "a long, b long")
    assert [tuple(r) for r in simhash.as_similar(pairs, sets, 0.8).collect()] == [(1, 2)]


def test_similar_documents_on_edge_rows(spark, awkward, clashing, rows_of):
    out = rows_of(simhash.similar_documents(awkward), "doc_id", "component_id")
    assert len(out) == 14
    assert [c for i, c in out if i in (1, 2, 3)] == [1, 1, 1] and [c for i, c in out if i in (4, 5)] == [4, 4, 4]
    assert out == rows_of(simhash.similar_documents(clashing), "doc_id", "component_id")
    full = clashing.selectExpr("*", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars")
    kept = corpus_pipeline.near_dedup(spark, full, "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in kept.collect()} >= {1, 4, 6, 7, 8, 9, 10, 11}


def joined_by_sets(docs, similarity=0.8):
    """Components of {id: words} by comparing all pairs of sets of five-word shingles."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in docs.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


def similar(spark, docs):
    return {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()}


def test_a_large_family_and_a_crowded_bucket(spark):
    """Hundreds of edited copies of one text, not all alike, and pairs of near copies crowded by others with the same passage."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    base, passage, docs = rng.choices(vocabulary, k=240), rng.choices(vocabulary, k=100), []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(240)] = rng.choice(vocabulary)
        docs.append(w)
    for _ in range(60):
        w = passage + rng.choices(vocabulary, k=60)
        docs += [w, w[:100] + rng.choices(vocabulary, k=12) + w[112:]]
    docs = dict(enumerate(docs))
    assert similar(spark, docs) == joined_by_sets(docs)


def test_a_repeated_line_does_not_join_texts(spark):
    """A line repeated to 45 % outvotes the rest of a fingerprint, but it is one of many different shingles."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    line = rng.choices(vocabulary, k=11)
    docs = {}
    for n in range(12):
        docs[n] = sum((line + rng.choices(vocabulary, k=13) for _ in range(82)), [])
    assert similar(spark, docs) == {n: n for n in docs}


def test_appended_removed_and_truncated_paragraphs(spark):
    """Copies with a change in one stretch, on both sides of the similarity: each pair as the sets have it."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    docs = {}
    for n in range(120):
        w, k = rng.choices(vocabulary, k=240), 40 + n % 30
        at = rng.randrange(20, 240 - k)
        docs[2 * n], docs[2 * n + 1] = w, (w + rng.choices(vocabulary, k=k), w[:at] + w[at + k - 4 :], w[: 240 - k])[n % 3]
    want = joined_by_sets(docs)
    assert similar(spark, docs) == want and 30 < sum(want[2 * n + 1] == 2 * n for n in range(120)) < 110


def test_pairs_just_at_the_similarity(spark):
    """The sets decide near 0.8: pairs from 0.78 to 0.82 are joined if and only if they reach it."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    docs = {}
    for n in range(150):
        w = rng.choices(vocabulary, k=204)
        docs[2 * n], docs[2 * n + 1] = w, list(w)
        for at in rng.sample(range(5, 195, 5), 4 + n % 3):
            docs[2 * n + 1][at] = "changed"
    want = joined_by_sets(docs)
    assert similar(spark, docs) == want and 40 < sum(want[2 * n + 1] == 2 * n for n in range(150)) < 110


@pytest.mark.parametrize("members", [200, 400, 800])
def test_pairs_grow_with_the_family_not_its_square(spark, members, monkeypatch):
    """Copies of one text, each with 12 of 240 words changed: most pairs of copies are below the similarity, all are near the text."""
    rng = random.Random(members)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    base = rng.choices(vocabulary, k=240)
    docs = [base]
    for _ in range(members):
        w = list(base)
        at = rng.randrange(20, 200)
        w[at : at + 12] = rng.choices(vocabulary, k=12)
        w[rng.randrange(20)] = rng.choice(vocabulary)
        docs.append(w)
    judged = []
    alike = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda pairs, sets, similarity: (judged.append(pairs.count()), alike(pairs, sets, similarity))[1])
    got = similar(spark, dict(enumerate(docs)))
    assert set(got.values()) == {0} and sum(judged) <= 12 * members


def test_one_of_each_by_row(spark):
    """Repeated rows become one; an id with two texts is two documents; rows without an id don't stand or fall together."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "an entirely different text of some words")
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, a, "x"), (None, c, "x"), (None, b, "x"), (None, "lonely words of a row without an id", "x"), (7, None, None), (8, "", None)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(3))
    assert out.columns == ["doc_id", "text", "extra"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, a, "x"), (1, b, "x"), (None, c, "x"), (None, "lonely words of a row without an id", "x"), (7, None, None)], key=repr)
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_key_filter_loses_no_key(spark):
    rng = random.Random(1)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(5000)]
    known = common.KeyFilter.of(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert known.has(np.array(keys)).all()
    assert known.has(np.array([rng.getrandbits(64) - (1 << 63) for _ in range(5000)])).mean() < 0.01


def test_tables_of_a_scope_go_at_its_end(spark):
    with common.scope(spark):
        with common.scope(spark):
            inner, kept = common.written(spark.range(3)), common.written(spark.range(4), outer=True)
        assert kept.count() == 4
        with pytest.raises(Exception):
            inner.count()
    with pytest.raises(Exception):
        kept.count()


@pytest.mark.parametrize("documents", [6_000, 12_000])
def test_passages_that_many_share_make_no_pairs(spark, documents):
    """A sentence of its own and one of 4,000 shared ones, twice over: shared shingles come last, whatever the size of the corpus."""
    rng = random.Random(documents)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    shared = [" ".join(word() for _ in range(14)) for _ in range(4000)]
    rows = [(n, " ".join([" ".join(word() for _ in range(14)), rng.choice(shared), " ".join(word() for _ in range(14)), rng.choice(shared)])) for n in range(documents)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    prints = simhash.prefixes(docs, "doc_id", "text", 5, 0.8, simhash.shingle_counts(docs, "text", 5))
    pairs = simhash.shared_shingles(prints).groupBy("s").count().select(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert (pairs or 0) < documents / 20
