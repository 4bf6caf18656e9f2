import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quarry.llm import common, packing, queries, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def counted(rows):
    model = Tokenizer.from_file(BYTE)
    return {(i, t): len(model.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_counts_equal_the_library(spark, sf_dir, texts):
    want = counted(texts.items())
    got = queries.op3_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), want[r.doc_id, texts[r.doc_id]], r.n_tokens > 1024)


def test_counts_of_awkward_texts(spark):
    texts = ["<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "  two  spaces \n\n tabs\t\t", "it's we'll I'D", "é‍\U0001f468‍\U0001f469", "1234567 890", "　wide space line", "aaaaaaaaaaa", "x" * 3000, "\x00\x1c\x85 z", "...!!!???", "word" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = counted(enumerate(texts))
    for r in token_counts.count_tokens(df, BYTE).collect():
        assert r.n_tokens == want[r.doc_id, texts[r.doc_id]], texts[r.doc_id]


def test_counts_edge_rows(awkward, clashing, nothing, rows_of):
    cols = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    out = rows_of(token_counts.count_tokens(awkward, BYTE), *cols)
    assert len(out) == 14 and (1, 0, 0, False) in out and (None, 0, 0, False) in out
    assert out == rows_of(token_counts.count_tokens(clashing, BYTE), *cols)
    assert token_counts.count_tokens(nothing, BYTE).count() == 0


def check_packed(rows, texts, size=2048):
    model = Tokenizer.from_file(WORD)
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert docs.keys() == texts.keys()
    for i, pieces in docs.items():
        ids = [*model.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return windows


def test_packing_is_a_round_trip(spark, sf_dir, texts):
    rows = queries.op10_sum_of_squares(spark, sf_dir).collect()
    windows = check_packed(rows, texts)
    short = sum(sum(r.length for r in w) < 2048 * (1 - packing.WASTE) - 1 for w in windows.values())
    assert short <= len({r.sequence_id >> packing.LOCAL_BITS for r in rows})
    assert sum(r.length for r in rows) >= 0.98 * 2048 * (len(windows) - short)


def test_little_is_cut_at_the_end_of_a_task():
    """1,250 documents with lengths like those at hand: what is packed by cutting open windows is a small share of all tokens."""
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(6.2, 1.0, 1250).astype(int) + 1, 20_000)
    rows = list(packing.pack_ids(((i, np.full(n, 7, dtype="<u4").tobytes()) for i, n in enumerate(lengths)), 2048, 0))
    pieces = defaultdict(list)
    for doc, start, n, _, total, sequence, offset in rows:
        pieces[doc].append((start, n, total))
    cut = sum(n for own in pieces.values() for start, n, total in own if n < 2048 and len(own) > -(-own[0][2] // 2048))
    assert sum(lengths) == sum(r[2] for r in rows) and cut < 0.05 * sum(lengths)


def test_packing_awkward_texts(spark, clashing, nothing):
    texts = {1: None, 2: "", 3: "<|startoftext|> a <|endoftext|>", 4: "don't Å Å it's 12 ab12", 5: "x" * 9000, 6: "z " * 9000, 7: "\x1cq\x85w　e ﻿", 8: "x<|endoftext|>y <|ENDOFTEXT|> Z", 9: "\u200b \u0301 É É ΣΑΣ İ K", 10: "UPPER Lower\nÇA d'I'LL"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packed(packing.pack(df, WORD).collect(), texts)
    assert packing.pack(clashing, WORD).where("start = 0").count() == 14
    assert packing.pack(nothing, WORD).count() == 0


def test_level_array_minimises_squares():
    levels = packing.Levels(10)
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = int(rng.integers(1, 10))
        n = levels.count.copy()

        def squares(level):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + s < 10:
                m[level + s] += 1
            return int((m[1:10] ** 2).sum())

        choices = [0, *(k for k in range(1, 11 - s) if n[k])]
        assert squares(levels.best(s)) == min(map(squares, choices))
        levels.place(s, s)


def test_long_words_of_varied_letters():
    """Words on both sides of LONG, repeated letters that overlap, and a word of a million letters within seconds."""
    import random
    import time

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    table, model, rng = token_counts.MergeTable(path), Tokenizer.from_file(path), random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (64, 65, 66, 1000, 20_000)]
    texts += ["a" * k for k in (64, 65, 66, 67, 131, 1000)] + ["ab" * 200, "aab" * 300, "é" * 100 + "中文" * 60]
    texts += [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 200))) for _ in range(40)) for _ in range(20)]
    assert table.count(texts) == [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    began = time.time()
    assert table.count(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))])[0] > 500_000
    assert time.time() - began < 60


def test_chunks_of_several_tasks_are_kept():
    asked = []
    kept = common.TwoGenerations(lambda keys: asked.extend(keys) or keys, packing.KEPT_CHUNKS)
    for n in (0, 1, 2, 0):
        kept.load({b"%d" % k for k in range(n * 160_000, (n + 1) * 160_000)})
    assert len(asked) == 480_000
