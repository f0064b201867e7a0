"""Tokenizers: array<struct<start,line,column,text>> columns, and words as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.functions import patterns as P
from lexora.functions import text as T
from lexora.functions.text import running
from lexora.operators import prose as prose_words

MIN_LENGTH = 4


def prose(text: Column, min_length: int = MIN_LENGTH) -> Column:
    return T.spans(text, P.PROSE, min_length)


def identifier_parts(text: Column) -> Column:
    """All parts of an identifier, unfiltered."""
    return F.regexp_extract_all(text, F.lit(P.IDENTIFIER), F.lit(0))


def is_candidate(token: Column, min_length: int = MIN_LENGTH, ignore: tuple[str, ...] = ()) -> Column:
    ok = (F.length(token) >= min_length) & ~token.rlike(r"^\p{Nd}+$") & ~token.rlike(r"^[0-9a-fA-F]{8,}$")
    ok = ok & ((F.length(token) < 20) | token.rlike(r"(?i)[aeiouy]"))
    for pattern in ignore:
        ok = ok & ~token.rlike(pattern)
    return ok


def identifier(text: Column, min_length: int = MIN_LENGTH, ignore: tuple[str, ...] = ()) -> Column:
    return F.filter(T.spans(text, P.IDENTIFIER), lambda s: is_candidate(s["text"], min_length, ignore))


def traced(tokens: Column, segments: Column, original: Column) -> Column:
    """Tokens of a processed text with their place in the original: sorted among segments, then among line breaks, each follows the last one before it."""
    event = lambda at, kind, k: F.struct(at.alias("at"), F.lit(kind).alias("kind"), k.alias("k"))

    def last_before(marks: Column, points: Column) -> Column:
        """For each point in order, the index of the last mark at or before it, or -1."""
        merged = F.array_sort(F.concat(F.transform(marks, lambda at, k: event(at, 0, k)), F.transform(points, lambda at, k: event(at, 1, k))))

        def latest(e: Column) -> Column:
            seen = running(F.transform(e, lambda x: F.when(x["kind"] == 0, x["k"]).otherwise(-1)), lambda a, b: F.greatest(a, b), -1)
            return F.transform(F.filter(F.zip_with(e, seen, lambda x, m: F.struct(x["kind"].alias("kind"), m.alias("m"))), lambda x: x["kind"] == 1), lambda x: x["m"])

        return T.bound(merged, latest)

    def back(segs: Column, t: Column, k: Column) -> Column:
        """Inside a segment by its shift; in a gap the end of the segment before; before all the first origin."""
        s = F.get(segs, k)
        return F.when(k < 0, F.get(segs, F.lit(0))["orig"]).otherwise(s["orig"] + F.least(t["start"] - s["out"], s["len"]))

    starts = lambda t: F.transform(t, lambda x: x["start"])
    offsets = T.bound(segments, lambda segs: F.zip_with(tokens, last_before(F.transform(segs, lambda s: s["out"]), starts(tokens)), lambda t, k: back(segs, t, k)))

    def numbered(at: Column, lines: Column) -> Column:
        placed = F.zip_with(at, last_before(lines, at), lambda o, k: F.struct(o.alias("offset"), (k + 1).alias("line"), (o - F.get(lines, k) + 1).alias("column")))
        return F.zip_with(tokens, placed, lambda t, p: F.struct(t["text"].alias("text"), t["line"].alias("line"), p["offset"].alias("offset"), p["line"].alias("original_line"), p["column"].alias("original_column")))

    return T.bound(offsets, lambda at: T.bound(T.line_starts(original), lambda lines: numbered(at, lines)))


def words(fragments: DataFrame, min_length: int = MIN_LENGTH, ignore: tuple[str, ...] = (), excerpts: bool = False) -> DataFrame:
    """A row per word: fragment columns without the texts, word_idx, word, line (in the processed text), parent, and in the original offset, original_line, original_column and, on demand, the excerpt.

    Prose is scanned over many texts at once; places in identifiers are found inside the fragment's row. No word carries the text with it.
    """
    kept = [c for c in fragments.columns if c not in ("text", "original_text", "offsets")]
    fields = ["word", "line", "offset", "original_line", "original_column", *["excerpt"] * excerpts]
    prosaic = prose_words.words(fragments.where(F.col("mode").isin("prose", "docblock")), kept, min_length, "text", excerpts, "offsets", "original_text")
    if excerpts:
        prosaic = prosaic.withColumn("excerpt", T.window(F.col("window"), F.col("cut_before"), F.col("cut_after")))
    prosaic = prosaic.select(*kept, F.lit(None).cast("string").alias("parent"), "word_idx", *fields)
    return prosaic.unionByName(_identifier_words(fragments.where("mode = 'identifier'"), kept, min_length, ignore, excerpts))


def _identifier_words(fragments: DataFrame, kept: list[str], min_length: int, ignore: tuple[str, ...], excerpts: bool) -> DataFrame:
    tokens = F.transform(identifier(F.col("text"), min_length, ignore), lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("line"), t["column"].alias("column"), t["text"].alias("text")))
    rows = fragments.withColumn("__tokens", tokens)
    moved = F.col("offsets").isNotNull() & (F.size("offsets") > 0)
    still = F.transform("__tokens", lambda t: F.struct(t["text"].alias("text"), t["line"].alias("line"), t["start"].alias("offset"), t["line"].alias("original_line"), t["column"].alias("original_column")))
    found = F.when(moved, traced(F.col("__tokens"), F.col("offsets"), F.col("original_text"))).otherwise(still)
    fields = ("text", "line", "offset", "original_line", "original_column")
    if excerpts:
        found = T.excerpts(F.col("original_text"), found, fields, "offset")
        fields = (*fields, "excerpt")
    rows = rows.select(*kept, F.col("text").alias("parent"), F.posexplode(found).alias("word_idx", "__word"))
    return rows.select("*", *[F.col(f"__word.{f}").alias("word" if f == "text" else f) for f in fields]).drop("__word")
