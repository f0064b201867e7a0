"""Findings: construction, filters, baseline, statistics, order."""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexora.errors import BaselineSchemaError
from lexora.functions import text as T
from lexora.operators import spellers
from lexora.schema import BASELINE
from lexora.staging import stage

SCHEMA_VERSION, FINGERPRINT_SCHEMA = 1, "v1"


def build(unknown: DataFrame, most: int = spellers.MAX_SUGGESTIONS) -> DataFrame:
    """Findings of unknown words (rows of tokenizers.words with excerpts, and suggestions): place, excerpt, fingerprint."""
    line, column = F.col("original_line"), F.col("original_column")
    place = F.col("location")
    php = F.col("context.source") == "php"
    new_line = F.when(php, place["line"] + line - 1).when(line > 1, place["line"] + line - 1).otherwise(place["line"])
    located = F.when(place.isNotNull(), F.struct(place["path"].alias("path"), new_line.cast("int").alias("line"), F.when(~php, column).alias("column"), place["logical"].alias("logical")))
    rows = unknown.withColumns({"location": located, "suggestions": spellers.formatted(F.col("word"), F.col("suggestions"), F.col("parent"), most)})
    rows = rows.withColumns({"type": F.lit("spelling"), "severity": F.lit("error"), "seed": T.seed(F.col("context"))})
    return rows.withColumn("fingerprint", T.fingerprint(F.col("seed"), F.col("word"))).select(
        "word", "type", "suggestions", "language", "context", "location", "excerpt", "severity", "fingerprint", "seed", "fragment_id", "word_idx"
    )


def ordered(findings: DataFrame) -> DataFrame:
    """By path, line and column (missing last), then word, then seed. Ranging reads its input twice, so that it is staged first."""
    if not hasattr(findings, "_staged"):
        findings = stage(findings, "findings")
    return findings.orderBy(*[F.col(f"location.{c}").asc_nulls_last() for c in ("path", "line", "column")], "word", "seed")


# --- filters ----------------------------------------------------------------


@dataclass(frozen=True)
class Filter:
    name: str
    priority: int
    apply: Callable[[DataFrame], DataFrame] = field(repr=False)


def dictionary_filter(known: DataFrame) -> Filter:
    """known(language, word)."""
    words = known.select("language", "word").distinct()
    return Filter("dictionary", 1000, lambda df: spellers.lacking(df, words))


def pattern_filter(patterns: list[str]) -> Filter:
    def apply(df: DataFrame) -> DataFrame:
        for p in patterns:
            df = df.where(~F.col("word").rlike(p))
        return df

    return Filter("pattern", 900, apply)


def deduplicated(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key, found by an aggregate, so that a hot key shrinks before it moves."""
    names = df.columns
    keyed = df.withColumns({f"__k{i}": k for i, k in enumerate(keys)})
    row = F.struct(*[F.struct(*order).alias("__order")], *[F.col(c) for c in names])
    return keyed.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min_by(row, row["__order"]).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in names])


def deduplication_filter() -> Filter:
    """The first of each fingerprint, line and column; missing ones are equal."""
    keys = [F.col("fingerprint"), F.coalesce(F.col("location.line"), F.lit(-1)), F.coalesce(F.col("location.column"), F.lit(-1))]
    return Filter("deduplication", 500, lambda df: deduplicated(df, keys, [F.col("fragment_id"), F.col("word_idx")]))


def baseline_filter(baseline: DataFrame, enabled: bool = True) -> Filter:
    seen = baseline.select("fingerprint").distinct()
    return Filter("baseline", 100, lambda df: df.join(spellers.small(seen), "fingerprint", "left_anti").select(*df.columns) if enabled else df)


def chain(findings: DataFrame, filters: list[Filter]) -> DataFrame:
    for f in sorted(filters, key=lambda f: -f.priority):
        findings = f.apply(findings)
    return findings


# --- baseline ---------------------------------------------------------------


def record(findings: DataFrame, order: list[str] | None = None, seen_at: str = "") -> DataFrame:
    """A baseline of findings; of equal fingerprints the last in order."""
    row = F.struct("word", "type", "language", F.col("context.attributes").alias("context"))
    last = F.max_by(row, F.struct(*(order or ["fragment_id", "word_idx"])))
    return findings.groupBy("fingerprint").agg(last.alias("r")).select("fingerprint", "r.word", "r.type", "r.language", "r.context", F.lit(seen_at).alias("seen_at"))


def suppressed(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi")


def outdated(baseline: DataFrame, findings: DataFrame) -> DataFrame:
    """Entries that no finding used."""
    return baseline.join(findings.select("fingerprint").distinct(), "fingerprint", "left_anti")


def pruned(baseline: DataFrame, findings: DataFrame) -> DataFrame:
    return baseline.join(findings.select("fingerprint").distinct(), "fingerprint", "left_semi")


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """All entries; where both have one, the other's."""
    pack = lambda df, name: df.select("fingerprint", F.struct(*[c for c in df.columns if c != "fingerprint"]).alias(name))
    both = pack(one, "a").join(pack(other, "b"), "fingerprint", "full_outer")
    return both.select("fingerprint", F.coalesce("b", "a").alias("r")).select("fingerprint", "r.*")


#: The keys of the file and of its entries are fixed values.
def save_baseline(baseline: DataFrame, path: str, config_hash: str = "", tool_version: str = "0.1.0", now: str | None = None) -> None:
    """Key-sorted JSON; the time stays if the keys are the same. A baseline is a file that people review, so its size is bounded by use."""
    entries = {r["fingerprint"]: {"word": r["word"], "type": r["type"], "language": r["language"], "context": dict(sorted((r["context"] or {}).items())), "seen_at": r["seen_at"]} for r in baseline.orderBy("fingerprint").toLocalIterator()}
    stamp = now or dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
        if set(old.get("entries", {})) == set(entries):
            stamp = old.get("generated_at", stamp)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    whole = {"schema": SCHEMA_VERSION, "generated_at": stamp, "tool_version": tool_version, "fingerprint_schema": FINGERPRINT_SCHEMA, "config_hash": config_hash, "entries": entries}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(whole, f, ensure_ascii=False, indent=4)
        f.write("\n")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A missing file is an empty baseline."""
    if not os.path.exists(path):
        return spark.createDataFrame([], BASELINE)
    with open(path, encoding="utf-8") as f:
        try:
            whole = json.load(f)
        except ValueError as e:
            raise BaselineSchemaError(f"{path}: not JSON") from e
    if not isinstance(whole, dict) or whole.get("schema") != SCHEMA_VERSION:
        raise BaselineSchemaError(f"{path}: unknown schema")
    if whole.get("fingerprint_schema", FINGERPRINT_SCHEMA) != FINGERPRINT_SCHEMA:
        raise BaselineSchemaError(f"{path}: unknown fingerprint schema")
    rows = []
    entries = whole.get("entries", {})
    if not isinstance(entries, dict) or not all(isinstance(v, dict) for v in entries.values()):
        raise BaselineSchemaError(f"{path}: malformed entries")
    for key, v in entries.items():
        rows.append((key, v.get("word", ""), v.get("type", "spelling"), v.get("language", ""), v.get("context") or {}, v.get("seen_at", "")))
    return spark.createDataFrame(rows, BASELINE)


def config_hash(path: str) -> str:
    """That of a baseline file; empty where there is none."""
    if not os.path.exists(path):
        return ""
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("config_hash", "")


def empty_baseline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BASELINE)


# --- statistics -------------------------------------------------------------


def statistics(fragments: DataFrame, words: DataFrame, suppressed_baseline: int = 0, suppressed_inline: int = 0, hits: int = 0, misses: int = 0) -> DataFrame:
    """One row of counts: fragments before processing, words after languages are resolved."""
    a = fragments.agg(F.count(F.lit(1)).alias("fragments"), F.count_distinct("location.path").alias("files_scanned"))
    b = words.agg(F.count(F.lit(1)).alias("words_checked"), F.count_distinct("language", F.lower("word")).alias("unique_words_checked"))
    c = words.groupBy("language").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "count")))).alias("words_per_language"))
    total = hits + misses
    rate = round(hits / total, 4) if total else 0.0
    return a.crossJoin(b).crossJoin(c).withColumns({  # single rows
        "suppressed_by_baseline": F.lit(suppressed_baseline).cast("long"), "suppressed_inline": F.lit(suppressed_inline).cast("long"),
        "cache_hits": F.lit(hits).cast("long"), "cache_misses": F.lit(misses).cast("long"), "cache_hit_rate": F.lit(rate),
    })


def exit_code(n_findings: int, diagnostic_codes: list[str], n_outdated: int = 0, fail_on_outdated: bool = False, fail_on_warning: bool = False, ignore_warnings: bool = False) -> int:
    if "fatal" in diagnostic_codes:
        return 2
    if n_findings or (fail_on_outdated and n_outdated):
        return 1
    if not diagnostic_codes:
        return 0
    return 1 if fail_on_warning else 0 if ignore_warnings else 3


def distinct_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """One row per code, message and place."""
    return deduplicated(diagnostics, [F.col("code"), F.col("message"), T.location_text(F.col("location"))], [F.col("code")])


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
