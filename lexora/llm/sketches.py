"""Operator 9 (native): bottom-k sketches of word shingles.

A sketch holds the k smallest distinct 32-bit hashes of a text's shingles of
five words (lower case; fewer words: all of them). Sketches merge, and
estimate resemblance, containment and the number of distinct shingles. All is
built from DataFrame functions.

Neighbour texts. The next document in descending id order is found on ids
alone: ranges of ids, a window inside each, and one row per range for the
seams. Texts move twice: once to their row's key, and once, cut to what is
needed, to the key of the row before.

Defined cases: a null text is empty; an empty text has an empty sketch, like
another empty one at 1 and unlike others at 0; rows with null ids come last in
descending order; equal ids are ordered by their place in the input; a table
of one document follows itself; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.llm.common import pinned, stage, text_of

K = 96
WORDS = 5


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def sketch_of_words(hashes: Column, words: int = WORDS, k: int = K) -> Column:
    """The sketch of a text from the hashes of its words; hashes must be a column, not an expression, as it is read often."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - F.lit(words - 1), F.lit(1)))
    shingles = F.transform(starts, lambda x, i: F.shiftright(F.xxhash64(x, *[F.get(hashes, i + F.lit(j)) for j in range(1, words)]), 32).cast("int"))
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of both that both have; two empty sketches: 1."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**31)) / F.lit(2.0**32)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(share, F.lit(1e-9)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; an empty a: 1."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_groups(rows: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """(key, sketch) of each group's union; a rank limit prunes before the shuffle, so a hot key sends k values a task."""
    values = rows.select(key, F.explode(sketch).alias("v")).distinct()
    w = Window.partitionBy(key).orderBy("v")
    return values.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy(key).agg(F.sort_array(F.collect_list("v")).alias(sketch))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__row, doc_id, n_chars, sketch of every document, in place."""
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("__row", "doc_id", F.length("text").cast("long").alias("n_chars"), word_hashes(F.col("text")).alias("hashes"))
    return rows.select("__row", "doc_id", "n_chars", sketch_of_words(F.col("hashes")).alias("sketch"))


def chain(rows: DataFrame) -> DataFrame:
    """__row, before (the row that this one follows in descending id order, the first follows the last), need (half of that row's n_chars)."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("__row").asc()]
    ids = rows.select("doc_id", "__row", F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    ranged = stage(ids.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "chain")
    w = Window.partitionBy("range").orderBy(*order)
    inside = ranged.select("range", "__row", F.lag("__row").over(w).alias("before"), F.lag("half").over(w).alias("need"), F.lead("__row").over(w).isNull().alias("last"), "half")
    ends = sorted(inside.where("last").select("range", "__row", "half").collect())  # one row per range
    seams = [(r["range"], ends[k - 1]["__row"], ends[k - 1]["half"]) for k, r in enumerate(ends)]
    seam = F.broadcast(spark.createDataFrame(seams or [(-1, -1, 0)], "range int, seam_row long, seam_half int"))
    return inside.join(seam, "range").select("__row", F.coalesce("before", "seam_row").alias("before"), F.coalesce("need", "seam_half").alias("need"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    docs = pinned(docs)
    prints = stage(sketches(docs, id_col, text_col), "sketches")
    texts = docs.select(F.monotonically_increasing_id().alias("__row"), text_of(text_col).alias("text"))
    placed = texts.join(prints.join(chain(prints), "__row"), "__row")
    follower = placed.select(F.col("before").alias("__row"), F.col("text").substr(F.lit(1), F.col("need")).alias("tail"), F.col("sketch").alias("next_sketch"))
    own = placed.select("__row", "doc_id", "n_chars", "sketch", F.col("text").substr(F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")).alias("head"))
    both = own.join(follower, "__row").withColumn("edited", F.concat("head", "tail"))
    both = both.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.col("edited"), 256).alias("edited_sha256"), word_hashes(F.col("edited")).alias("hashes"))
    both = both.select("doc_id", "n_chars", "sketch", "next_sketch", "edited_sha256", sketch_of_words(F.col("hashes")).alias("edited_sketch"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def as_text(sketch: Column) -> Column:
    return F.array_join(sketch.cast("array<string>"), ",")
