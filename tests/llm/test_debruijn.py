import random

import numpy as np
import pytest

from quarry.llm import debruijn


def brute(rows, window):
    """n_words, n_removed and the text that stays, window by window; rows as they come."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(i, first.get(k, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return sorted(out, key=repr)


def result(df, **options):
    return sorted((tuple(r) for r in debruijn.without_repeats(df, **options).collect()), key=repr)


def text(rng, n, letters="abcdefghij"):
    return [rng.choice(letters) + rng.choice(letters) for _ in range(n)]


@pytest.mark.parametrize("window,anchor", [(50, 13), (12, 4), (5, 2), (6, 6)])
def test_words_equal_those_of_all_windows(spark, window, anchor):
    rng = random.Random(window)
    shared = [text(rng, rng.randrange(window - 2, 4 * window)) for _ in range(6)]
    rows = []
    for n in range(70):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += text(rng, rng.randrange(0, 2 * window)) + rng.choice(shared)[rng.choice((0, 0, 3)) :]
        if rng.random() < 0.4:  # near copies: a few words replaced
            words = list(rows[0][1].split()) if rows else words
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = "zz"
        rows.append((rng.randrange(60), "\t\n ".join(words) if n % 3 else " ".join(words)))
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, " \n "), (503, "w " * (4 * window)), (504, "w " * (3 * window + 1)), (505, " ".join(shared[0][: window - 1])), rows[1], (3, "é \U0001f600 " * 60), (4, "é \U0001f600 " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df, window=window, anchor=anchor) == brute(rows, window)


def test_awkward_rows(awkward, clashing, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert result(awkward) == result(clashing) == brute(rows, 50)
    assert result(nothing) == []


def test_spans_are_whole_and_say_where_from(spark):
    rng = random.Random(9)
    passage = text(rng, 400)
    rows = [(1, " ".join(text(rng, 30) + passage)), (2, " ".join(passage + text(rng, 60))), (3, " ".join(text(rng, 7) + passage + text(rng, 9)))]
    found = debruijn.spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {}
    for r in found.collect():
        assert r.source.id == 1
        got.setdefault(r.id, []).append((r.start, r.n, r.source.start))
    for i, lead in ((2, 0), (3, 7)):
        assert all(source - start == 30 - lead for start, _, source in got[i])
        covered = {s for start, n, _ in got[i] for s in range(start, start + n)}
        assert covered == set(range(lead, lead + 351))
        assert max(n for _, n, _ in got[i]) > 200 and len(got[i]) < 60  # paths, not single windows


def test_least_places_are_leftmost():
    rng = np.random.default_rng(4)
    for width in (1, 2, 3, 7, 38):
        x = rng.integers(0, 5, 200).astype(np.uint64) << np.uint64(32)
        want = [s + int(np.argmin(x[s : s + width])) for s in range(len(x) - width + 1)]
        assert debruijn.least_places(x, width).tolist() == want
