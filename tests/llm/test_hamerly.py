import math
import random

import pytest

from quarry.llm import hamerly

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd in whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    size = len(kept[0][1])
    where = [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]
    books = [[list(v[a:b]) for _, v, _ in kept[:entries]] for a, b in where]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))
    near = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p, (a, b) in enumerate(where):
            own = [near(v[a:b], books[p]) for _, v, _ in kept]
            for k in range(len(books[p])):
                mine = [v[a:b] for (_, v, _), o in zip(kept, own) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for i, v, lab in kept:
        code = [near(v[a:b], books[p]) for p, (a, b) in enumerate(where)]
        out.append((i, code, sum(far(v[a:b], books[p][code[p]]) for p, (a, b) in enumerate(where)), lab))
    totals = {}
    for *_, e, lab in out:
        totals[lab] = totals.get(lab, 0) + e
    return sorted(((i, c, e, totals[lab]) for i, c, e, lab in out), key=repr), ",".join(str(x) for book in books for c in book for x in c)


def compressed(df, **options):
    got = hamerly.compressed(df, **options).collect()
    texts = {r.codebooks for r in got}
    assert len(texts) <= 1
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr), "".join(texts)


@pytest.mark.parametrize("size,n", [(16, 300), (8, 60), (13, 80), (5, 40), (64, 9)])
def test_codes_equal_plain_rounds(spark, size, n):
    random.seed(size)
    spots = [[random.gauss(0, 1) for _ in range(size)] for _ in range(7)]
    rows = [(k, [x + random.gauss(0, 0.05) for x in random.choice(spots)], random.choice((None, 1, 2))) for k in random.sample(range(10 * n), n)]
    rows += [(5_000, None, 1), (5_001, [math.nan] + [0.0] * (size - 1), 1), (5_002, [None] + [0.0] * (size - 1), 1), (5_003, [math.inf] * size, 1), rows[0], (None, rows[1][1], None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    single = [tuple(r) for r in df.collect()]  # components as single-precision numbers
    assert compressed(df) == brute(single)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(k, [float(k // 2)] * 8, k % 2) for k in range(16)] + [(100 + k, [k + 0.5] * 8, None) for k in range(7)] + [(200, [-3.0] * 8, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert compressed(df) == brute(rows)


def test_bounds_save_scans(spark):
    random.seed(1)
    spots = [[random.gauss(0, 1) for _ in range(16)] for _ in range(16)]
    rows = [(k, [x + random.gauss(0, 0.01) for x in spots[k % 16]], 0) for k in range(800)]
    scans = []
    assert compressed(spark.createDataFrame(rows, SCHEMA), scans=scans) == brute([tuple(r) for r in spark.createDataFrame(rows, SCHEMA).collect()])
    assert len(scans) == 7 and 800 * 7 <= scans[0] <= 800 * 8 and sum(scans[1:]) < scans[0] / 4


def test_nothing_and_odd_tables(spark):
    assert compressed(spark.createDataFrame([], SCHEMA)) == ([], "")
    assert compressed(spark.createDataFrame([(1, None, 1)], SCHEMA)) == ([], "")
    assert compressed(spark.createDataFrame([(1, [0.5] * 16, None)], SCHEMA)) == brute([(1, [0.5] * 16, None)])
    assert compressed(spark.createDataFrame([(1, [], 3), (2, [], None)], SCHEMA)) == ([(1, [0] * 8, 0, 0), (2, [0] * 8, 0, 0)], "")
    assert [r[0] for r in compressed(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 9, 1)], SCHEMA))[0]] == [1]  # of another size than the first
    huge = compressed(spark.createDataFrame([(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1)], SCHEMA), entries=1)[0]
    assert all(0 < r[2] < 1 << 63 for r in huge)


def test_clashing_columns(spark):
    rows = [(k, [k / 7] * 8, k % 3) for k in range(40)]
    df = spark.createDataFrame([(*r, 1, 2, [3.0], 4) for r in rows], f"{SCHEMA}, id int, v int, x array<double>, error int")
    assert compressed(df) == brute([tuple(r)[:3] for r in df.collect()])
