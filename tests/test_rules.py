import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import dedup, niches, rules
from quarry.operators.niches import Niche, exact, token
from quarry.sources import tables

SMALL = (
    Niche("a", ("ab", "abc"), ((exact("x", "1", "2"), token("y", "p", "q")), (exact("z", "9"),)), ((exact("x", "1"),),), ("ab", "é f")),
    Niche("b", ("abc", "bcd"), ((exact("x", "1"),),), ((token("y", "q"),),), ("é f",)),
)


@pytest.fixture(scope="module")
def tables_of_small(spark):
    return rules.registry(spark, SMALL)


def test_a_rule_holds_if_all_its_conditions_do(spark, tables_of_small):
    rows = [(1, {"x": " 1 ", "y": "r; Q"}), (2, {"x": "2"}), (3, {"z": "9", "y": ";q;q"}), (4, {"x": "", "y": " "}), (5, None), (6, {}), (7, {"y": "p"}), (None, {"x": "1"}), (8, {"x": "1;2"})]
    got = {(r.id, r.niche, r.kind) for r in rules.held_rules(spark.createDataFrame(rows, "id long, tags map<string,string>"), tables_of_small[0]).collect()}
    assert got == {(1, "a", "RULE"), (1, "a", "CONTEXT"), (1, "b", "RULE"), (1, "b", "CONTEXT"), (3, "a", "RULE"), (3, "b", "CONTEXT"), (None, "a", "CONTEXT"), (None, "b", "RULE")}


def test_rules_equal_those_written_as_expressions(spark):
    conditions, aliases = rules.registry(spark)
    random.seed(3)
    shops, beauties, names = ("beauty", "hairdresser", "nail_salon", "barber", "pet", None, " "), ("nails", "eyebrow;massage", "hair_removal", None), ("unha rosa", "salao x", "spa", "", None, "barber shop")
    rows = [(i, {k: v for k, v in (("shop", random.choice(shops)), ("beauty", random.choice(beauties)), ("amenity", random.choice(("cafe", "clinic", None))), ("barber", random.choice(("yes", "no")))) if v is not None}, random.choice(names)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, tags map<string,string>, name string")
    got = {(r.id, r.niche): r.kind for r in rules.classified(df, conditions, aliases).collect()}
    for n in niches.NICHES:
        want = df.select("id", niches.diagnosis(n, F.col("tags"), F.col("name")).alias("k"), niches.is_potential(n, F.col("tags"), F.col("name")).alias("p")).collect()
        assert {(r.id, n.name): r.k for r in want if r.p} == {k: v for k, v in got.items() if k[1] == n.name}


def test_aliases_resolve(spark):
    _, aliases = rules.registry(spark)
    asked = {
        "Barbearia": ("barber", "barbearia"), "salão de beleza": ("hairdresser", "salao de beleza"), "clínica de estética avançada": ("beauty", "clinica de estetica"), "manicure e pedicure": ("nails", "manicure"),
        "Advocacia Silva": ("lawyer", "advocacia"), "pet shop": ("pet", "pet"), "Depilação a Laser": ("hair_removal", "depilacao a laser"), "hair removal studio": ("hair_removal", "hair removal"), "Esmaltação": ("nails", "esmaltacao"),
        "xyz desconhecido": ("xyz desconhecido", None), "": ("", None), None: ("", None), "padarias": ("bakery", "padaria"), "spa " * 30_000: ("massage", "spa"),
    }
    got = spark.createDataFrame([(a,) for a in asked], "a string").select("a", rules.resolved(aliases, F.col("a")).alias("x")).collect()
    assert {r.a: (r.x.niche, r.x.alias) for r in got} == asked


def test_words_show_a_niche(spark, tables_of_small):
    rows = [("ab",), ("cab",), ("x É  F!",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(rules.shown(tables_of_small[1], F.lower(F.regexp_replace(F.translate("t", "É", "e"), "\\W+", " "))).alias("x")).collect()
    assert [[(y.niche, y.alias) for y in r.x] for r in got] == [[("a", "ab")], [], [("a", "e f"), ("b", "e f")], [], []]


def test_no_registry_and_no_places(spark):
    conditions, aliases = rules.registry(spark, ())
    df = spark.createDataFrame([(1, {"shop": "beauty"}, "unha")], "id long, tags map<string,string>, name string")
    assert rules.classified(df, conditions, aliases).count() == 0
    assert rules.classified(df.limit(0), *rules.registry(spark)).count() == 0


def scanned(rows):
    taken, out = set(), set()
    for r, *ks in sorted(rows):
        own = {(n, k) for n, k in enumerate(ks) if k is not None}
        if not own & taken:
            taken |= own
            out.add(r)
    return out


@pytest.mark.parametrize("together", [5, 100_000])
def test_greedy_acceptance_of_chains_and_crowds(spark, together):
    random.seed(5)
    chain = [(n, n // 2, (n + 1) // 2) for n in range(40)]
    crowd = [(100 + n, random.choice((None, 7, *range(100, 120))), random.choice((None, *range(200, 230)))) for n in range(150)]
    rows = chain + crowd
    got = {r["rank"] for r in dedup.greedy_accept(spark.createDataFrame(rows, "rank long, p long, i long"), "rank", ["p", "i"], together).where("accepted").collect()}
    assert got == scanned(rows)


def test_a_chain_of_ten_thousand(spark):
    rows = spark.range(10_000).select(F.col("id").alias("rank"), F.floor(F.col("id") / 2).alias("p"), F.floor((F.col("id") + 1) / 2).alias("i"))
    got = dedup.greedy_accept(rows, "rank", ["p", "i"]).where("accepted")
    assert got.where("rank % 2 = 0").count() == got.count() == 5_000


def test_tables_are_published_together(spark, tmp_path):
    root = str(tmp_path / "root")
    assert tables.published(spark, root) == {}
    assert tables.publish_all(spark, root, {"a": spark.range(3), "b": spark.range(2)}) == 1
    assert tables.publish_all(spark, root, {"a": spark.range(5)}) == 2
    count = lambda **v: {k: df.count() for k, df in tables.published(spark, root, **v).items()}
    assert count() == {"a": 5, "b": 2} and count(version=1) == {"a": 3, "b": 2}
    with pytest.raises(Exception):
        tables.publish_all(spark, root, {"a": spark.range(9), "b": spark.range(3).select(F.assert_true(F.col("id") < 2))})
    assert count() == {"a": 5, "b": 2}
    assert tables.publish_all(spark, root, {"b": spark.range(1)}) == 3
    assert len(tables.expired(spark, root, keep=1)) == 2 and count() == {"a": 5, "b": 1}
