"""The operators' queries over the driver's tables: whole tables, whole texts, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import embedding_dedup, exact_dedup, html_extract, lang_id, lm_score, packing, sharding, simhash, sp_bpe, substring_dedup
from shutterlake.llm.common import narrow
from shutterlake.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return substring_dedup.dedup_lines(docs)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs, ~lang_id.held_out("doc_id", 4))
    rows = narrow(docs, doc_id="doc_id", held_out=lang_id.held_out("doc_id", 4), text="text")
    return lang_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = ~lang_id.held_out("doc_id", 7)
    done = lm_score.score(docs, trained := lm_score.train(docs, learned), learned)
    return done.select(F.col("id").alias("doc_id"), lang_id.held_out("id", 7).alias("held_out"), "n_tokens", "n_known", F.lit(trained.model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.simhash_components(table(spark, sf_dir, "documents"), n=3, max_bits=2)
    return done.select(F.col("id").alias("doc_id"), simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


_OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_OP8_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
    SELECT * FROM v WHERE e IS NOT NULL AND list_aggregate(list_transform(e, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0
                      AND list_dot_product(e, e) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), r AS (
    SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""


def queries() -> dict[str, Query]:
    found = (op1_sharding, op2_substring_dedup, op3_exact_dedup, op4_html_extraction, op5_language_id, op6_lm_scoring, op7_packing, op8_embedding_dedup, op9_sentencepiece, op10_simhash)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding_sql(), "op3_exact_dedup": _OP3_SQL, "op8_embedding_dedup": _OP8_SQL}


def sharding_sql(shards: int = 8, seed: int = 0) -> str:
    """The query op1_sharding in DuckDB: integer arithmetic throughout, with the checksum as a fold over bytes."""
    prime = sharding.PRIME
    layers = "SELECT *, x // b AS l0, x % b AS r0 FROM ({rows})"
    for i, (k, m) in enumerate(sharding.round_keys(seed)):
        moved, by, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        layers = f"SELECT *, ({by}{i} + {k}) % {prime} AS p{i} FROM ({layers})"
        layers = f"SELECT *, (p{i} * p{i} + {m}) % {prime} AS q{i} FROM ({layers})"
        layers = f"SELECT *, ({moved}{i} + (q{i} * q{i} + q{i} * {m} % {prime}) % {prime}) % {side} AS {moved}{i + 1}, {by}{i} AS {by}{i + 1} FROM ({layers})"
    last = sharding.ROUNDS
    step = f"SELECT doc_id, size, text_crc32, a, b, n, l{last} * b + r{last} AS x FROM ({layers})"
    return f"""
    WITH RECURSIVE crc_table AS (
        SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
    ), bytes AS (
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS d FROM documents
    ), sums AS (
        SELECT doc_id, size, CASE WHEN size = 1 THEN 0 ELSE
               xor(4294967295, list_reduce(list_prepend(4294967295, d), lambda c, v: xor(c >> 8, t[CAST(xor(c, v) & 255 AS INTEGER) + 1]))) END AS text_crc32
        FROM bytes, crc_table
    ), numbered AS (
        SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS n FROM sums
    ), sides AS (
        SELECT doc_id, size, text_crc32, CAST(ceil(sqrt(n)) AS BIGINT) AS a,
               (n + CAST(ceil(sqrt(n)) AS BIGINT) - 1) // CAST(ceil(sqrt(n)) AS BIGINT) AS b, n, x FROM numbered
    ), walked AS (
        {step.format(rows="SELECT doc_id, size, text_crc32, a, b, n, x FROM sides")}
        UNION ALL {step.format(rows="SELECT * FROM walked WHERE x >= n")}
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard,
           CAST(x // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM walked WHERE x < n
    """
