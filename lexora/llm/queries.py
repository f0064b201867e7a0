"""The op queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexora.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.llm.packing import pack
    from lexora.llm.vocab import vocabulary_path

    return pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.llm.token_store import round_trip
    from lexora.llm.vocab import vocabulary_path

    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.llm.sketches import edited

    return edited(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexora.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_store, op2_decontaminate, op3_simhash, op4_warc, op5_pii, op6_packing, op7_html_text, op8_substrings, op9_sketches, op10_toxicity)}

#: DuckDB SQL where SQL can express a query.
ORACLES: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_bytes >= 100 AND p.payload_digest = f.payload_digest
""",
}
