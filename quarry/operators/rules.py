"""The niches' registry as tables: rules by relational division, aliases by one automaton.

Nothing of the registry stands in a plan, so it may grow and change like any table.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_key, normalize_phrase, present
from ..sources.tables import materialized
from .niches import NICHES, Niche

#: Aliases that one automaton may have: it goes to every task.
MOST_ALIASES = 1_000_000
CONDITION = "niche string, kind string, rule int, conditions int, condition int, key string, mode string, value string"


def registry(spark: SparkSession, niches: Iterable[Niche] = NICHES) -> tuple[DataFrame, DataFrame]:
    """``conditions`` (a row per value that a rule's condition takes) and ``aliases`` (``kind``, ``niche``, ``alias``, ``pos``), as tables.

    Rules are of kind RULE, strong ones, or CONTEXT. Aliases of kind NAME resolve to
    their niche, and the words of those of kind EVIDENCE show it; ``pos`` is the order
    in which they were registered. Two spellings that fold to one are one alias.
    """
    conditions, aliases = [], []
    for niche in niches:
        for kind, rules in (("RULE", niche.rules), ("CONTEXT", niche.context)):
            for r, rule in enumerate(rules):
                conditions += [(niche.name, kind, r, len(rule), c, key, mode, v) for c, (key, mode, values) in enumerate(rule) for v in values]
        aliases += [("NAME", niche.name, a) for a in niche.aliases] + [("EVIDENCE", niche.name, a) for a in niche.evidence]
    rows = spark.createDataFrame([(n, *x) for n, x in enumerate(aliases)], "pos int, kind string, niche string, alias string")
    folded = rows.groupBy("kind", "niche", normalize_key(F.col("alias")).alias("alias")).agg(F.min("pos").alias("pos"))
    return materialized(spark.createDataFrame(conditions, CONDITION)), materialized(folded)


def held_rules(places: DataFrame, conditions: DataFrame, id_col: str = "id", tags_col: str = "tags") -> DataFrame:
    """``id_col``, ``niche``, ``kind`` of the rules that hold: those all of whose conditions the place's tags meet.

    A place's tags become terms (the whole value, and each of its parts between
    semicolons), which are looked up in the table of conditions; a rule holds if as
    many different conditions are met as it has. Only terms that some condition asks
    for are grouped. A place without tags, or with blank ones only, has no rule.
    """
    pairs = places.select(F.col(id_col).alias("id"), F.explode(F.col(tags_col)).alias("key", "raw")).select("id", "key", present(F.col("raw")).alias("raw")).where("raw IS NOT NULL")
    value = F.lower(F.trim("raw"))
    parts = F.transform(F.split(F.lower("raw"), ";"), lambda x: F.struct(F.lit("token").alias("mode"), F.trim(x).alias("value")))
    terms = pairs.select("id", "key", F.explode(F.concat(F.array(F.struct(F.lit("exact").alias("mode"), value.alias("value"))), parts)).alias("t")).select("id", "key", "t.mode", "t.value")
    met = terms.join(conditions, ["key", "mode", "value"]).groupBy("id", "niche", "kind", "rule", "conditions").agg(F.size(F.collect_set("condition")).alias("met"))
    return met.where("met = conditions").select(F.col("id").alias(id_col), "niche", "kind").distinct()


class Aliases:
    """An automaton of all aliases, each with a value; it finds all that stand anywhere in a text in one pass."""

    def __init__(self, rows: list[tuple[str, object]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        values: dict[str, list] = {}
        for alias, value in rows:
            values.setdefault(alias, []).append(value)
        for alias, found in values.items():
            self.automaton.add_word(alias, (alias, tuple(found)))
        self.automaton.make_automaton()

    def found(self, text: str | None) -> dict[str, tuple]:
        """The aliases in ``text``, each with its values."""
        return dict(x for _, x in self.automaton.iter(text)) if text and len(self.automaton) else {}


def _rows(aliases: DataFrame, *columns: str) -> list:
    found = aliases.select(*columns).limit(MOST_ALIASES + 1).collect()
    if len(found) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    return [tuple(r) for r in found]


def resolved(aliases: DataFrame, text: Column) -> Column:
    """``niche`` and ``alias`` of a text: by the exact alias, else the longest one contained (the first registered of equals), else the text itself and no alias."""
    known = _rows(aliases.where("kind = 'NAME'"), "alias", "niche", "pos")

    @F.pandas_udf("alias string, niche string")
    def lookup(keys: pd.Series) -> pd.DataFrame:
        automaton = Aliases([(a, (pos, niche)) for a, niche, pos in known])

        def one(key: str | None) -> tuple:
            met = automaton.found(key)
            alias = key if key in met else min(met, key=lambda a: (-len(a), min(met[a])[0]), default=None)
            return (alias, min(met[alias])[1]) if alias else (None, None)

        return pd.DataFrame([one(k) for k in keys], columns=["alias", "niche"], dtype=object)

    found = lookup(normalize_key(text))
    return F.struct(F.coalesce(found["niche"], normalize_phrase(text)).alias("niche"), found["alias"].alias("alias"))


def shown(aliases: DataFrame, phrase: Column) -> Column:
    """The niches of which a normalised text has an alias as whole words, with the first such alias: an array of ``niche``, ``alias``."""
    known = _rows(aliases.where("kind = 'EVIDENCE'"), "alias", "niche", "pos")

    @F.pandas_udf("array<struct<niche:string,alias:string>>")
    def lookup(texts: pd.Series) -> pd.Series:
        automaton = Aliases([(f" {a} ", (pos, niche, a)) for a, niche, pos in known])

        def one(text: str | None) -> list[dict]:
            first: dict[str, str] = {}
            for _, niche, alias in sorted(v for values in automaton.found(f" {text or ''} ").values() for v in values):
                first.setdefault(niche, alias)
            return [{"niche": n, "alias": a} for n, a in first.items()]

        return pd.Series([one(t) for t in texts], dtype=object)

    return lookup(phrase)


def classified(places: DataFrame, conditions: DataFrame, aliases: DataFrame, id_col: str = "id", tags_col: str = "tags", name_col: str = "name") -> DataFrame:
    """A row for each place and niche that is worth a look: ``strong``, ``context``, ``alias`` (in the name) and ``kind``.

    ``kind`` is STRUCTURED_RULE if a strong rule holds, NAME_FALLBACK if a rule of
    context does and the name has an alias, else NO_MATCH. Null ids are places of
    one id; places with neither rules nor aliases give no row.
    """
    rules = held_rules(places, conditions, id_col, tags_col).groupBy(F.col(id_col).alias("id"), "niche").agg(F.max(F.col("kind") == "RULE").alias("strong"), F.max(F.col("kind") == "CONTEXT").alias("context"), F.lit(None).cast("string").alias("alias"))
    named = places.select(F.col(id_col).alias("id"), F.explode(shown(aliases, normalize_phrase(F.col(name_col)))).alias("x")).select("id", "x.niche", F.lit(False).alias("strong"), F.lit(False).alias("context"), "x.alias")
    both = rules.unionByName(named).groupBy("id", "niche").agg(F.max("strong").alias("strong"), F.max("context").alias("context"), F.max("alias").alias("alias"))
    kind = F.when(F.col("strong"), "STRUCTURED_RULE").when(F.col("context") & F.col("alias").isNotNull(), "NAME_FALLBACK").otherwise("NO_MATCH")
    return both.select(F.col("id").alias(id_col), "niche", "strong", "context", "alias", kind.alias("kind"))


def catalog(places: DataFrame, conditions: DataFrame, aliases: DataFrame, niche: str, id_col: str = "id") -> DataFrame:
    """The places of the catalog that a niche can take, for a page of them to be cut by name and id.

    ``places``: tags, name, active, qualified, whatsapp_verified, instagram_validated,
    phone, instagram. All flags must be set and the three texts be there; and a strong
    rule of the niche must hold, or one of context with an alias in the name.
    """
    usable = places.where("active AND qualified AND whatsapp_verified AND instagram_validated")
    for c in ("phone", "instagram", "name"):
        usable = usable.where(F.trim(c) != "")
    of = F.col("niche") == niche
    taken = classified(usable, conditions.where(of), aliases.where(of), id_col).where("kind <> 'NO_MATCH'").select(F.col(id_col).alias("__id"))
    return usable.join(taken, F.col(id_col) == F.col("__id"), "left_semi")
