"""Dictionaries as DataFrames (word, language, pos, source); NULL language means all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.schema import DICTIONARY

BUILTIN = {
    "technical": "api async auth backend boolean cache config cron datetime debug enum frontend hash http https json kubernetes localhost middleware mutex namespace nullable oauth parser plugin regex runtime schema sql stdout timestamp tokenizer unicode url utf uuid webhook xml yaml".split(),
    "php": "autoload callable composer foreach instanceof iterable mbstring namespace nullsafe opcache packagist phpunit preg readonly sprintf stdclass strlen traversable xdebug yield".split(),
    "symfony": "autowire bundle dotenv flex kernel messenger monolog profiler serializer subscriber twig validator voter workflow".split(),
}


def builtin(spark: SparkSession, names: list[str]) -> DataFrame:
    unknown = [n for n in names if n not in BUILTIN]
    if unknown:
        raise ValueError(f"unknown dictionaries: {', '.join(unknown)}; there are {', '.join(sorted(BUILTIN))}")
    return spark.createDataFrame([(w, None, k, n) for n in names for k, w in enumerate(BUILTIN[n])], DICTIONARY)


def from_words(spark: SparkSession, words: list[str], language: str | None = None, source: str = "inline") -> DataFrame:
    return clean(spark.createDataFrame([(w, language, k, source) for k, w in enumerate(words)] or [], DICTIONARY))


def clean(words: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Trimmed, lower-cased unless case counts, one row per word and language (the first)."""
    word = F.trim("word") if case_sensitive else F.lower(F.trim("word"))
    rows = words.select(word.alias("word"), "language", "pos", "source").where("word <> ''")
    return rows.groupBy("word", "language").agg(F.min("pos").alias("pos"), F.min_by("source", "pos").alias("source"))


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A word per line; '#' starts a comment; `name.<locale>.txt` scopes a list to its locale."""
    lines = spark.read.text(paths, wholetext=False).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("pos"))
    word = F.trim(F.regexp_replace("value", r"\s+#.*$", ""))
    locale = F.regexp_extract("path", r"[^/]*\.([a-z]{2,3}(?:[_-][A-Za-z0-9]{2,8})*)\.txt$", 1)
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return clean(rows.select(word.alias("word"), F.when(locale != "", F.replace(locale, F.lit("-"), F.lit("_"))).alias("language"), "pos", "path").withColumnRenamed("path", "source"))


def aggregate(*dictionaries: DataFrame) -> DataFrame:
    """Members in order: every word of each, positions shifted so that earlier members come first."""
    out = None
    for k, d in enumerate(dictionaries):
        d = d.withColumn("pos", F.col("pos") + F.lit(k * (1 << 40)))
        out = d if out is None else out.unionByName(d)
    return out


def version_hash(words: DataFrame) -> DataFrame:
    """One row: 16 hex digits that fix the content."""
    each = F.sha2(F.concat_ws("|", F.coalesce("language", F.lit("")), "word"), 256)
    # an order-free sum of hashes, so that no task holds all words
    part = F.conv(F.substring(each, 1, 14), 16, 10).cast("decimal(38,0)")
    return words.select("word", "language").distinct().agg(F.substring(F.sha2(F.concat_ws("|", F.coalesce(F.sum(part), F.lit(0)).cast("string"), F.count(F.lit(1)).cast("string")), 256), 1, 16).alias("version_hash"))


def lines(words: DataFrame, header: str | None = None) -> DataFrame:
    """The sorted lines of a dictionary file: by lower case, then bytes."""
    rows = words.select(F.trim("word").alias("value")).where("value <> ''").distinct().orderBy(F.lower("value"), "value")
    if header is None:
        return rows
    head = words.sparkSession.createDataFrame([(f"# {x}",) for x in header.splitlines()], "value string")
    return head.unionByName(rows)


def covers(dictionary_language: Column, language: Column) -> Column:
    """NULL covers all; else equal, or one is the other with a region."""
    return dictionary_language.isNull() | (dictionary_language == language) | dictionary_language.startswith(F.concat(language, F.lit("_"))) | language.startswith(F.concat(dictionary_language, F.lit("_")))


def for_languages(words: DataFrame, languages: list[str]) -> DataFrame:
    """(language, word): the dictionary expanded once to the languages of a run, so that lookups are equi joins."""
    known = F.broadcast(words.sparkSession.createDataFrame([(x,) for x in languages] or [], "run_language string"))
    rows = words.join(known, covers(words["language"], F.col("run_language")))
    return rows.groupBy(F.col("run_language").alias("language"), "word").agg(F.min("pos").alias("pos"))


def resolve_locale(locale: str, available: list[str] | None = None, overrides: dict[str, str] | None = None) -> str | None:
    """The dictionary language of a locale."""
    overrides = overrides or {}
    locale = locale.strip().replace("-", "_")
    base = next((x for x in locale.split("_") if x), locale)
    for key in (locale, base):
        if key in overrides:
            return overrides[key]
    if not available:
        return f"{base}_{base.upper()}" if locale == base else locale
    if locale in available:
        return locale
    return next((a for a in available if a.startswith(base + "_")), base if base in available else None)


def resolve_column(languages: DataFrame, column: str, available: list[str] | None = None, overrides: dict[str, str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """language, resolved (or NULL), status: ok, unsupported_language or missing_dictionary; for the distinct languages of a run."""
    rows = []
    for r in languages.select(column).where(F.col(column).isNotNull()).distinct().collect():  # a row per language
        base = r[0].replace("-", "_").split("_")[0]
        found = None if base in (excluded or []) else resolve_locale(r[0], available, overrides)
        rows.append((r[0], found, "unsupported_language" if base in (excluded or []) else "ok" if found else "missing_dictionary"))
    return languages.sparkSession.createDataFrame(rows or [], "language string, resolved string, status string")
