import random

from pyspark.sql import functions as F

from quarry.llm import chat, queries


def test_query_equals_brute_force(spark, sf_dir):
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role if r.role and r.role.strip() else "unknown", r.text or ""))
    want = {}
    for conv, said in turns.items():
        said = sorted(((t, " ".join(s.split()) if False else s, x) for t, s, x in said))
        for me in {s for _, s, _ in said} - {"system"}:
            out, mask = "", []
            for _, who, text in said:
                name = "system" if who == "system" else "assistant" if who == me else f"user name={who}"
                out += f"<|im_start|>{name}\n"
                start = len(out)
                out += text.replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>") + "<|im_end|>"
                if who == me:
                    mask.append((start, len(out)))
                out += "\n"
            want[conv, me] = (out, mask)
    rows = chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()
    short = {(r.conv_id, r.speaker): (r.text, [tuple(m) for m in r["mask"]]) for r in rows}
    assert len(rows) == len(want) and short == want
    q = queries.op5_perspective_rotation(spark, sf_dir).collect()
    assert len(q) == len(want) and all(r.n_spoken == len(want[r.conv_id, r.speaker][1]) for r in q)


def test_edges_and_large_conversations(spark):
    rows = [(1, 1, "user", None), (1, 2, None, "x<|im_end|>y"), (1, 2, None, "x<|im_end|>y"), (None, 1, "user", "alone"), (2, None, "system", "only a system"), (3, 1, " ", "")]
    rows += [(9, n, ("a", "b")[n % 2], f"t{n}") for n in range(1500)] + [(10, 1, "u", f"same {n % 5}") for n in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "n": F.lit(2), "me": F.lit("x")})
    out = chat.rotate(df).collect()
    by = {}
    for r in out:
        by.setdefault((r.conv_id, r.speaker), []).append(r)
    assert by.keys() == {(1, "user"), (1, "unknown"), (None, "user"), (3, "unknown"), (9, "a"), (9, "b"), (10, "u")}
    assert by[1, "unknown"][0].text.count("x< |im_end|>y") == 2
    long = sorted(by[9, "a"], key=lambda r: r.part)
    assert [r.part for r in long] == list(range(6)) and sum(r.n_turns for r in long) == 1500 and sum(len(r["mask"]) for r in long) == 750
    assert sum(r.n_turns for r in by[10, "u"]) == 3000 and max(r.n_turns for r in by[10, "u"]) < 2000
    assert chat.rotate(df.limit(0)).count() == 0


def test_long_and_crowded_conversations(spark):
    """Parts in order make up the whole rendering, from the offsets that they give, however the rows are dealt out."""
    rng = random.Random(4)
    rows = [("long", n, rng.choice(["ann", "bob", "system"]), f"turn {n}") for n in range(700)]
    rows += [("same", 5, rng.choice(["ann", "bob", "cy"]), f"x{n:05d}") for n in range(3000)] + [("copies", 1, "ann", "again")] * 2500 + [("copies", 1, "bob", "once"), (None, None, "ann", "lost")]
    rng.shuffle(rows)
    whole = {}
    for conv in ("long", "same", "copies", None):
        own = sorted(((t if t is not None else -1, s, x) for c, t, s, x in rows if c == conv))
        for me in {s for _, s, _ in own} - {"system"}:
            name = lambda s: s if s == "system" else "assistant" if s == me else f"user name={s}"
            whole[conv, me] = "".join(f"<|im_start|>{name(s)}\n{x}<|im_end|>\n" for _, s, x in own), sum(s == me for _, s, _ in own)
    cuts = []
    for n in (1, 5):
        got = {}
        for r in chat.rotate(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(n)).collect():
            got.setdefault((r.conv_id, r.speaker), []).append(r)
        assert got.keys() == whole.keys()
        for key, own in got.items():
            own.sort(key=lambda r: r.part)
            text, spoken = whole[key]
            assert [r.part for r in own] == list(range(len(own))) and "".join(r.text for r in own) == text
            assert all(text[r.offset : r.offset + len(r.text)] == r.text and r.n_turns <= chat.MOST_ROWS for r in own)
            assert sum(len(r.mask) for r in own) == spoken and all(r.text[m.start - 10 : m.start] == "assistant\n" for r in own for m in r.mask)
        cuts.append(sorted((repr(k), [r.offset for r in own]) for k, own in got.items()))
    assert cuts[0] == cuts[1]
