"""Queries ``opN_*`` over the shared tables, and their DuckDB forms where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, lm, quality, secrets, sentencepiece_codec, simhash, token_counts, toxicity, warc
from .scratch import materialise

VOCABULARY = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The path of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def second_vocabulary() -> tuple[str, str]:
    """The path and pattern of the byte-level vocabulary for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=0)
    held = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, bits=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), least=100)
    body = F.col("payload")
    narrow = records.select(
        "page_id",
        F.coalesce(F.octet_length(body).cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2(body, 256), "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    return warc.checked(materialise(narrow, "records"))


def op4_lm_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), held_out=1)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_table(table(spark, sf_dir, "documents"), vocabulary())
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, share=0.8)


def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.quality_rules(table(spark, sf_dir, "documents"), vocabulary(), second=second_vocabulary())
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *quality.MEASURES)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), vocabulary())
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_table(table(spark, sf_dir, "documents"), vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_simhash_neardup, op3_warc_round_trip, op4_lm_interpolation, op5_line_dedup, op6_token_counts, op7_decontamination, op8_fertility_rules, op9_secret_scan, op10_sentencepiece)
}

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest FROM pages),
        f AS (SELECT digest, min(page_id) AS first FROM p WHERE strlen(body) >= 100 GROUP BY digest)
        SELECT p.page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN first IS NOT NULL AND p.page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS NOT NULL AND p.page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.digest = f.digest AND strlen(body) >= 100""",
    "op5_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, {LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
        o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
        j AS (SELECT k.doc_id, pos, line, owner IS NULL OR owner = k.doc_id AS keep FROM k LEFT JOIN o ON k.key = o.key)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN keep THEN 0 ELSE 1 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op7_decontamination": f"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWERED.format("coalesce(text, '')")}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
        i AS (SELECT item_id, list_filter(regexp_split_to_array({LOWERED.format("coalesce(text, '')")}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(len(ws), 5) AS width, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda k: array_to_string(ws[k:k + 4], ' '))) AS shingle FROM i WHERE len(ws) > 0),
        n AS (SELECT item_id, count(*) AS n_shingles FROM g GROUP BY item_id),
        d AS (SELECT DISTINCT doc_id, s.width, unnest(list_transform(range(1, len(ws) - s.width + 2), lambda k: array_to_string(ws[k:k + s.width - 1], ' '))) AS shingle
              FROM w, (SELECT DISTINCT width FROM g) s WHERE len(ws) >= s.width),
        m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN g USING (width, shingle) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_shingles AS BIGINT) AS n_shingles, n_shared / n_shingles AS containment
        FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9""",
}
