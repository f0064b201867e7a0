"""The stateless part of a check on a stream of fragments: processors, words, dictionary; each micro-batch needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.functions import text as T
from lexora.operators import processors as P
from lexora.operators import tokenizers


def unknown_words(fragments: DataFrame, known: DataFrame, processors: list[P.Processor] | None = None) -> DataFrame:
    """Unknown words of a streaming (or batch) fragments DataFrame; known(language, word) is static."""
    done = P.ProcessorChain(tuple(processors if processors is not None else [P.normalize_apostrophe(), P.html(), P.url()])).apply(fragments)
    rows = tokenizers.words(done).withColumn("__lower", F.lower("word"))
    missing = rows.join(known.select("language", F.col("word").alias("__lower")).distinct(), ["language", "__lower"], "left_anti")
    return missing.select("fragment_id", "word", "language", "offset", "line", T.fingerprint(T.seed(F.col("context")), F.col("word")).alias("fingerprint"))
