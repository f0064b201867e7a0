"""The corpus pipeline: documents go through STAGES in order.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works
on all that the stage before kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.llm import decontaminate, packing, pii, simhash, toxicity
from lexora.llm.common import fresh, stage, table, unstage
from lexora.llm.vocab import vocabulary_path

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labelled training rows. Null and empty texts, null ids and repeated rows are scored like others."""
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), fresh(docs, "score")
    return toxicity.score(docs, model, keep_as=score).where(F.col(score) < TOXIC).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest id; groups are linked by SimHash as in op3 (two bits at most), and by five-word shingles of similarity 0.8 or more. Of texts without words one stays."""
    return simhash.drop_copies(docs, radius=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go; rows without an id can't be named and stay."""
    found = stage(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaked")
    few = found.count() <= 1_000_000  # 8 bytes each
    found = found.withColumnRenamed("doc_id", "leaked_id")
    return docs.join(F.broadcast(found) if few else found, docs["doc_id"] == found["leaked_id"], "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a mark of its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids; a null or empty text is its end id. Workers give memory back, as executors are full from the stages before."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"), frugal=True)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", drop_leaks), ("pii", mask_personal_data), ("packing", pack_sequences)]

#: SQL can't express the trained models, the tokenizer and the packing order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        before, docs = docs, apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
            unstage(before)  # the input's files are not staged, and stay
    return docs
