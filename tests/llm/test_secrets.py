import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from quarry.llm import queries, secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base(text):
    text = text or ""
    found = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    order = ("assign", "access", "hex")
    return sorted(((m.start(), order.index(k), m.end()) for k, m in found))


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_equal_brute_force(spark, sf_dir, texts):
    for r in queries.op2_randomness_secrets(spark, sf_dir).collect():
        want = base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(","))


def test_edge_rows(awkward, clashing, nothing, rows_of):
    out = secrets.find_secrets(awkward.withColumn("extra", F.lit(1)))
    got = out.select("doc_id", F.size("base"), secrets.span_text(F.col("spans"))).collect()
    assert len(got) == 14 and all(r[1] == 0 for r in got if r[0] in (1, 2, 3, 9, 10))
    assert [r[2] for r in got if r[0] == 7] == ["assign:0:26,access:28:48,hex:49:65"]
    assert secrets.find_secrets(clashing).count() == 14 and secrets.find_secrets(nothing).count() == 0


def test_random_keys_are_found_and_words_are_not(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["".join(rng.choices("etaoinshrdlu", weights=[12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3], k=rng.randint(3, 9))) for _ in range(500)]
    docs = []
    for n in range(600):
        text = " ".join(rng.choices(words, k=40)) + " " + "_".join(w.title() for w in rng.choices(words, k=4))
        docs.append((n, f"{text} {''.join(rng.choices(letters, k=40))} end" if n % 3 == 0 else text))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: r[1] for r in secrets.find_secrets(df).select("doc_id", secrets.span_text(F.col("spans"))).collect()}
    hits = sum("random" in got[n] for n in range(0, 600, 3))
    assert hits >= 180
    assert sum("random" in got[n] for n in range(600) if n % 3) <= 12


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=abcdefabcdef1234 é deadbeefdeadbeef z")], "doc_id long, text string")
    text = secrets.find_secrets(df).select(secrets.redacted(F.col("text"), F.col("spans"))).first()[0]
    assert text == "a [secret] é [secret] z"


def plain_battery(docs, rate):
    """The random spans by plain Python: encodings, three tests, Fisher's method, Benjamini-Hochberg within classes."""
    phi = lambda z: math.erfc(-z / math.sqrt(2)) / 2
    runs = []
    for i, text in docs.items():
        taken = [(s, e) for s, _, e in base(text)]
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", text):
            body = m[0].rstrip("=")
            code = next((n for n, (_, letters, _) in enumerate(secrets.ENCODINGS) if set(body) <= set(letters)), None)
            if code is None:
                continue
            _, letters, bias = secrets.ENCODINGS[code]
            k, n = len(letters), len(body)
            chi2 = sum(body.count(c) ** 2 for c in set(body)) * k / n - n
            even = phi((chi2 - (k - 1) - n * bias) / math.sqrt(2 * (k - 1) + 4 * n * bias))
            at = [letters.index(c) for c in body]
            half = [a >= k // 2 for a in at]
            changes = sum(a != b for a, b in zip(half, half[1:]))
            runs_z = abs(changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)
            middle = (k - 1) / 2
            serial_z = abs(sum((a - middle) * (b - middle) for a, b in zip(at, at[1:]))) / ((k * k - 1) / 12 * math.sqrt(n - 1))
            ps = [max(even, math.exp(-secrets.TOP_LEVEL / 16)), *(max(2 * phi(z / secrets.SPREAD) - 1, 0.01) for z in (runs_z, serial_z))]
            x = -sum(map(math.log, ps))
            level = min(secrets.TOP_LEVEL, max(0, math.floor((x - math.log(1 + x + x * x / 2)) * 16)))
            kind = code * secrets.CLASSES + min(secrets.CLASSES - 1, math.floor(4 * math.log2(len(m[0]))) - 16)
            runs.append((kind, level, i, m.start(), m.end(), any(s < m.end() and m.start() < e for s, e in taken)))
    found = {i: [] for i in docs}
    for kind in {r[0] for r in runs}:
        own = sorted((r for r in runs if r[0] == kind), key=lambda r: -r[1])
        passing = [r[1] for r in own if math.exp(-r[1] / 16) <= rate * sum(x[1] >= r[1] for x in own) / len(own)]
        for r in own:
            if passing and r[1] >= min(passing) and not r[5]:
                found[r[2]].append((r[3], 3, r[4]))
    return {i: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base(docs[i]) + spans)) for i, spans in found.items()}


def test_random_spans_equal_brute_force(spark):
    """Runs of all encodings, random or of words, alone and beside base matches."""
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(300)]
    docs = {}
    for n in range(240):
        letters = secrets.ENCODINGS[n % len(secrets.ENCODINGS)][1]
        key = "".join(rng.choices(letters, k=rng.randint(20, 90)))
        joined = rng.choice(["_", "", "-", "/"]).join(rng.choices(words, k=5))
        docs[n] = " ".join([*rng.choices(words, k=8), key + "=" * (n % 3), joined, f"token={key}" if n % 7 == 0 else "end"])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r[0]: r[1] for r in secrets.find_secrets(df, rate=0.01).select("doc_id", secrets.span_text(F.col("spans"))).collect()}
    assert got == plain_battery(docs, 0.01) and sum("random" in s for s in got.values()) > 60


def test_keys_of_one_class_of_letters(spark):
    """Random lower-case and upper-case keys of 72 characters among words glued together; decimal ones are base matches already."""
    rng = random.Random(9)
    words = ["".join(rng.choices("etaoinshrdlucmfwyp", weights=[12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2], k=rng.randint(3, 9))) for _ in range(500)]
    docs = []
    for n, letters in enumerate((secrets.LOWER, secrets.UPPER, secrets.DIGITS)):
        docs += [(100 * n + k, "".join(rng.choices(letters, k=72))) for k in range(40)]
        docs += [(1000 + 100 * n + k, ("".join(rng.choices(words, k=16))[:72]) if n == 0 else "plain words") for k in range(60)]
    got = {r[0]: r[1] for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", secrets.span_text(F.col("spans"))).collect()}
    assert all(sum("random" in got[100 * n + k] for k in range(40)) >= 30 for n in range(2))
    assert all(got[200 + k] == "hex:0:72" for k in range(40))
    assert sum("random" in got[1000 + k] for k in range(60)) <= 2


def test_tails_of_the_normal_distribution(spark):
    zs = [-12.0, -8.0, -6.0, -5.0, -4.0, -3.0, -1.5, -0.3, 0.0, 0.4, 2.0, 5.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", secrets.phi(F.col("z"))).collect()
    for z, p in got:
        assert math.isclose(p, math.erfc(-z / math.sqrt(2)) / 2, rel_tol=1.5e-7)


def test_false_discoveries_stay_within_the_rate(spark):
    """Joined words beside random keys: of all that is found, three in a hundred at most are words, for a rate of one."""
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgk", weights=[12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 1, 1, 1, 1], k=rng.randint(3, 9))) for _ in range(800)]
    keys = [(n, "".join(rng.choices(letters, k=rng.randint(24, 60)))) for n in range(1000)]
    joined = [(2000 + n, "".join(w.title() for w in rng.choices(words, k=rng.randint(4, 9)))) for n in range(1500)]
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in keys + joined], "doc_id long, text string")
    found = {r[0] for r in secrets.find_secrets(df).where(F.exists("spans", lambda s: s["rank"] == 3)).select("doc_id").collect()}
    false = sum(i >= 2000 for i in found)
    assert len(found) - false >= 850 and false <= 0.03 * len(found)
