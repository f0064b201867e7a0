"""Text processors: DataFrame transforms of fragments that keep every character traceable.

A processor has a priority and ``apply(fragments) -> fragments``; chains run
by descending priority. Offsets stay NULL until something moves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.functions import offsets as O
from lexora.functions import patterns as P
from lexora.functions import text as T
from lexora.operators import docblock, icu
from lexora.schema import OFFSETS


@dataclass(frozen=True)
class Processor:
    name: str
    priority: int
    apply: Callable[[DataFrame], DataFrame] = field(repr=False)


def _replaced(df: DataFrame, text: Column, segments: Column) -> DataFrame:
    both = df.withColumns({"__text": text, "__segments": segments})
    return both.withColumns({"offsets": O.compose(F.col("offsets"), F.col("__segments")), "text": F.col("__text")}).drop("__text", "__segments")


def regex(name: str, priority: int, pattern: str) -> Processor:
    """Each match becomes one space; kept runs are recorded."""

    def apply(df: DataFrame) -> DataFrame:
        clean, segments = O.blanked(F.col("text"), pattern)
        return _replaced(df, clean, segments)

    return Processor(name, priority, apply)


APOSTROPHES = ("’‘ʼ  ", "'''  ")


def normalized(text: Column) -> Column:
    return F.translate(text, *APOSTROPHES)


def normalize_apostrophe() -> Processor:
    return Processor("apostrophe", 1000, lambda df: df.withColumn("text", normalized(F.col("text"))))


def plural_parts(text: Column) -> Column:
    """array<struct<start,raw,value>> of the plural forms of a message that are not blank; null where no single pipe parts it."""
    raw = T.spans(text, P.PLURAL_PART)

    def part(s: Column) -> Column:
        body = F.regexp_replace(s["text"], P.PLURAL_RULE, "")
        lead = F.length(s["text"]) - F.length(body)
        left = F.regexp_replace(body, r"^[ \t\n\r\x00\x0B]++", "")
        return F.struct((s["start"] + lead + F.length(body) - F.length(left)).alias("start"), left.alias("raw"), T.trimmed(F.replace(body, F.lit("||"), F.lit("|"))).alias("value"))

    parts = F.filter(F.transform(raw, part), lambda p: p["value"] != "")
    whole = F.aggregate(raw, F.lit(0), lambda a, s: a + F.length(s["text"]))
    return F.when(whole < F.length(text), parts)


def legacy_plural() -> Processor:
    """Splits translation messages at single pipes; a doubled pipe is a literal one, with exact segments around it."""

    def apply(df: DataFrame) -> DataFrame:
        splits = (F.col("context.source") == "translation") & F.contains("text", F.lit("|"))
        parts = df.withColumn("__parts", F.when(splits, plural_parts(F.col("text")))).where("__parts is null or size(__parts) > 0")
        parts = parts.withColumn("__part", F.explode_outer("__parts")).drop("__parts")
        halves = F.split(F.col("__part.raw"), r"\|\|", -1)
        joined = F.zip_with(halves, F.slice(halves, F.lit(2), F.size(halves)), lambda h, after: F.when(after.isNotNull(), F.length(h) + 1).otherwise(F.length(h)))
        outs = T.running(joined)
        sources = T.running(F.transform(halves, lambda h: F.length(h) + 2))
        segments = F.zip_with(F.zip_with(outs, sources, lambda o, s: F.struct(o.alias("o"), s.alias("s"))), joined, lambda p, j: F.struct(p["o"].alias("out"), (p["s"] + F.col("__part.start")).cast("int").alias("orig"), j.alias("len")))
        whole = F.col("__part").isNull()  # a message without parts stays as it is
        return _replaced(parts, F.when(whole, F.col("text")).otherwise(F.col("__part.value")), F.when(~whole, segments)).drop("__part")

    return Processor("legacy_plural", 900, apply)


def icu_message(mode: str = "auto", domain_suffix: str = "+intl-icu") -> Processor:
    """Expands the text spans of ICU messages; a message that does not parse is dropped (see icu_diagnostics)."""

    def apply(df: DataFrame) -> DataFrame:
        wanted = icu_wanted(mode, domain_suffix)
        rows = df.withColumn("__wanted", F.coalesce(wanted, F.lit(False))).withColumn("__icu", icu.expand_udf(F.when(F.col("__wanted"), F.col("text"))))
        rows = rows.where(~F.col("__wanted") | F.col("__icu.error").isNull()).withColumn("__span", F.explode_outer("__icu.spans"))
        rows = rows.where(~F.col("__wanted") | F.col("__span").isNotNull()).drop("__icu")
        segments = F.transform("__span.segments", lambda s: F.struct(s["out"].alias("out"), s["orig"].alias("orig"), s["len"].alias("len")))
        return _replaced(rows, F.when(F.col("__wanted"), F.col("__span.text")).otherwise(F.col("text")), segments).drop("__span", "__wanted")

    return Processor("icu_message", 800, apply)


def icu_wanted(mode: str = "auto", domain_suffix: str = "+intl-icu") -> Column:
    translation = F.coalesce(F.col("context.source") == "translation", F.lit(False))
    domain = F.coalesce(F.endswith(F.element_at("context.attributes", "domain"), F.lit(domain_suffix)), F.lit(False))
    if mode == "always":
        return translation
    return translation & (domain | F.col("text").rlike(P.ICU_HINT) if mode == "auto" else domain)


def icu_diagnostics(df: DataFrame, mode: str = "auto", domain_suffix: str = "+intl-icu") -> DataFrame:
    bad = df.where(icu_wanted(mode, domain_suffix)).select("location", icu.expand_udf("text").alias("x")).where("x.error is not null")
    return bad.select(F.lit("icu_syntax").alias("code"), F.col("x.error").alias("message"), "location")


def placeholder() -> Processor:
    return regex("placeholder", 700, P.PLACEHOLDER)


def sprintf() -> Processor:
    return regex("sprintf", 600, P.SPRINTF)


def html() -> Processor:
    return regex("html", 500, P.HTML)


def markdown() -> Processor:
    return regex("markdown", 400, P.MARKDOWN)


def url() -> Processor:
    return regex("url", 300, P.URL)


def doc_block(strict_tags: bool = True) -> Processor:
    def apply(df: DataFrame) -> DataFrame:
        wanted = (F.col("mode") == "docblock") & ~T.is_blank(F.col("text"))
        rows = df.withColumn("__wanted", F.coalesce(wanted, F.lit(False))).withColumn("__doc", docblock.clean_udf(strict_tags)(F.when(F.col("__wanted"), F.col("text"))))
        return _replaced(rows, F.when(F.col("__wanted"), F.col("__doc.text")).otherwise(F.col("text")), F.when(F.col("__wanted"), F.col("__doc.segments").cast(OFFSETS))).drop("__doc", "__wanted")

    return Processor("doc_block", 200, apply)


def from_pandas(name: str, priority: int, function: Callable[[pd.Series], pd.Series]) -> Processor:
    """An opaque text function of equal-length results as a processor; offsets are left as they are."""
    wrapped = F.pandas_udf(function, "string")
    return Processor(name, priority, lambda df: df.withColumn("text", wrapped("text")))


def default_processors() -> list[Processor]:
    return [normalize_apostrophe(), legacy_plural(), icu_message(), placeholder(), sprintf(), html(), markdown(), url(), doc_block()]


@dataclass(frozen=True)
class ProcessorChain:
    processors: tuple[Processor, ...]

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.ordered()]

    def ordered(self) -> list[Processor]:
        return sorted(self.processors, key=lambda p: -p.priority)

    def apply(self, fragments: DataFrame) -> DataFrame:
        """Fragments after all processors, without blank ones."""
        for p in self.ordered():
            fragments = p.apply(fragments)
        return fragments.where(~T.is_blank(F.col("text")))
