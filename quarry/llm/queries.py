"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, debruijn, decontamination, hamerly, licenses, packing, patricia, quality, secrets, sharding, simhash, token_counts, toxicity
from .common import table


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = toxicity.toxicity(docs, docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    spoken = F.aggregate("mask", F.lit(0), lambda a, m: a + m["end"] - m["start"]).cast("long")
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "speaker", F.col("part").cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), F.col("offset").cast("long").alias("offset"), F.size("mask").cast("long").alias("n_spoken"), spoken.alias("spoken_chars"), spans.alias("mask"), "text")


def op6_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_patricia_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patricia.prefix_trie(table(spark, sf_dir, "conversations"), lambda c: c - F.pmod(c, F.lit(5)), lambda c: F.crc32(c.cast("string").cast("binary")) % 9)


def op12_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hamerly.compressed(table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select("vec_id", digits.alias("code"), "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


def op13_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = debruijn.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_nnpu_toxicity, op2_randomness_secrets, op3_token_counts, op4_license_index, op5_perspective_rotation, op6_boosted_quality, op7_spaced_seeds, op8_sampled_splitters, op9_simhash_covering, op10_sum_of_squares, op11_patricia_trie, op12_hamerly_codes, op13_debruijn_spans)
}

OP13_SQL = r"""
WITH words AS MATERIALIZED (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS MATERIALIZED (
    SELECT row, doc_id, s, sha256(array_to_string(w[s : s + 49], ' ')) AS k FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words)
), firsts AS (
    SELECT k, min(doc_id) AS first FROM windows GROUP BY k
), gone AS (
    SELECT row, list(DISTINCT p) AS ps FROM (SELECT row, unnest(range(s, s + 50)) AS p FROM windows JOIN firsts USING (k) WHERE first < doc_id) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
    sha256(array_to_string([w[i] for i in range(1, len(w) + 1) if ps IS NULL OR NOT list_contains(ps, i)], ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (row)
"""

OP11_SQL = """
WITH turns AS MATERIALIZED (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS MATERIALIZED (
    SELECT c, c - ((c % 5) + 5) % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h
    FROM (SELECT DISTINCT c FROM turns)
), numbered AS MATERIALIZED (
    SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d FROM (
        SELECT convs.c, 0 AS part, pos, role, text FROM convs JOIN turns ON turns.c = base AND pos <= h
        UNION ALL SELECT c, 1, pos, role, text FROM convs JOIN turns USING (c) WHERE pos > h)
), visits AS MATERIALIZED (
    SELECT c, 0 AS d, [] AS k, NULL AS up, 0 AS b FROM convs
    UNION ALL SELECT c, d, k, k[1 : len(k) - 1], b FROM (SELECT c, d, list(sha256(concat(len(role), ':', role, text))) OVER (PARTITION BY c ORDER BY d) AS k, octet_length(encode(text)) AS b FROM numbered)
), nodes AS MATERIALIZED (
    SELECT k, min(d) AS d, min(c) AS conv_id, count(*) AS n_convs, min(up) AS up, min(b) AS b FROM visits GROUP BY k
), kids AS MATERIALIZED (
    SELECT up AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up
), below AS (
    SELECT u.k, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * b)::BIGINT AS saved_tokens
    FROM (SELECT DISTINCT a.k, v.k AS under FROM visits a JOIN visits v ON a.c = v.c AND v.d >= a.d) u JOIN nodes ON nodes.k = under LEFT JOIN kids ON kids.k = under GROUP BY u.k
), ends AS (
    SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k FROM visits GROUP BY c) GROUP BY k
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN nodes p ON p.k = n.up
"""


def op12_sql(rounds: int = 6) -> str:
    """Lloyd's algorithm without bounds, a few common tables a round."""
    out = ["""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
    SELECT row, i // (len(v) // 8) AS p, i % (len(v) // 8) AS j, v[i + 1] AS x FROM (SELECT row, v, unnest(range(len(v))) AS i FROM kept)
), book0 AS MATERIALIZED (
    SELECT p, e, j, x AS c FROM cells JOIN (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept ORDER BY vec_id, v LIMIT 16) USING (row)
)"""]
    for n in range(rounds + 1):
        out.append(f"""near{n} AS MATERIALIZED (
    SELECT row, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT row, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM cells JOIN book{n} USING (p, j) GROUP BY row, p, e) GROUP BY row, p
)""")
        if n < rounds:
            out.append(f"""book{n + 1} AS MATERIALIZED (
    SELECT p, e, j, coalesce((s - ((s % k) + k) % k) // k, c) AS c FROM book{n} LEFT JOIN (
        SELECT p, best.e AS e, j, sum(x)::BIGINT AS s, count(*) AS k FROM cells JOIN near{n} USING (row, p) GROUP BY ALL
    ) USING (p, e, j)
)""")
    return "WITH " + ", ".join(out) + f""", coded AS (
    SELECT row, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY row
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (row)"""


ORACLE_SQL: dict[str, str] = {"op11_patricia_trie": OP11_SQL, "op12_hamerly_codes": op12_sql(), "op13_debruijn_spans": OP13_SQL}
