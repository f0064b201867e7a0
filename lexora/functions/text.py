"""Column functions on texts: spans of matches, lines, excerpts, distances, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BITS = 6


def bound(value: Column, body) -> Column:
    """body(value), with value computed once though body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine=lambda a, b: a + b, zero: int = 0) -> Column:
    """What all integers before each combine to (their sum, or with F.greatest their maximum).

    Blocks of values are folded into what comes before each of their members;
    as such a list is copied at every step, blocks are short, and each is put
    on top of what the blocks before it come to.
    """
    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def over(v: Column) -> Column:
        last = F.shiftright(F.greatest(F.size(v) - 1, F.lit(0)), BLOCK_BITS)
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(v, F.shiftleft(b, BLOCK_BITS) + 1, F.lit(1 << BLOCK_BITS)), start, step))

        def placed(each: Column) -> Column:
            ends = F.transform(each, lambda b: b["at"])
            bases = F.transform(ends, lambda _, k: F.aggregate(F.slice(ends, F.lit(1), k), F.lit(zero), combine))
            return F.flatten(F.zip_with(each, bases, lambda b, base: F.transform(b["out"], lambda x: combine(base, x))))

        return bound(blocks, placed)

    return bound(values, over)


def line_starts(text: Column) -> Column:
    """Where each line starts."""
    return running(F.transform(F.split(text, "\n", -1), lambda g: F.length(g) + 1))


def spans(text: Column, pattern: str, least: int = 0) -> Column:
    """array<struct<start,line,column,text>> of the matches of `least` or more characters.

    Starts are code points from 0, lines and columns count from 1; the pattern matches no line break.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    breaks = lambda g: F.length(g) - F.length(F.replace(g, F.lit("\n"), F.lit("")))
    pieces = F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.struct(F.length(g).alias("gap"), breaks(g).alias("lines"), h.alias("text"), F.coalesce(F.length(h), F.lit(0)).alias("size")))

    def placed(p: Column, lines: Column) -> Column:
        starts = running(F.transform(p, lambda x: x["gap"] + x["size"]))
        numbers = running(F.transform(p, lambda x: x["lines"]))
        both = F.zip_with(starts, numbers, lambda s, n: F.struct(s.alias("at"), n.alias("line")))

        def place(x: Column, at: Column) -> Column:
            start, line = at["at"] + x["gap"], at["line"] + x["lines"]
            return F.struct(start.alias("start"), (line + 1).alias("line"), (start - F.get(lines, line) + 1).alias("column"), x["text"].alias("text"))

        return F.filter(F.zip_with(p, both, place), lambda t: t["text"].isNotNull() & (F.length(t["text"]) >= least))

    return bound(pieces, lambda p: bound(line_starts(text), lambda lines: placed(p, lines)))


def excerpts(text: Column, items: Column, fields: tuple[str, ...], start: str = "start", radius: int = 32) -> Column:
    """items (structs with a start and a text) with an excerpt each; the text is cut in chunks once, so that no item scans it from its beginning."""
    size = 256
    chunks = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("chunks"), F.length(text).alias("length"))

    def one(whole: Column, t: Column) -> Column:
        begin, length = F.greatest(F.lit(0), t[start] - radius), F.length(t["text"])
        first = F.floor(begin / size).cast("int")
        near = F.array_join(F.slice(whole["chunks"], first + 1, (F.floor((length + 2 * radius) / size) + 2).cast("int")), "")
        return F.struct(*[t[f].alias(f) for f in fields], _excerpt(near, begin - first * size, begin, t[start], length, whole["length"], radius).alias("excerpt"))

    return bound(chunks, lambda whole: F.transform(items, lambda t: one(whole, t)))


def _excerpt(near: Column, at: Column, begin: Column, offset: Column, length: Column, whole: Column, radius: int) -> Column:
    return window(near.substr((at + 1).cast("int"), (length + 2 * radius).cast("int")), begin > 0, offset + length + radius < whole)


def window(inner: Column, cut_before: Column, cut_after: Column) -> Column:
    """An excerpt of the text around a word, and whether there is more before and after it."""
    inner = F.trim(F.regexp_replace(inner, r"[\p{Z}\t\n\x0B\f\r\x85]++", " "))
    return F.concat(F.when(cut_before, "...").otherwise(""), inner, F.when(cut_after, "...").otherwise(""))


def is_blank(text: Column) -> Column:
    return text.rlike(r"^[ \t\n\r\x00\x0B]*+$")


def trimmed(text: Column) -> Column:
    """Without ASCII white space and NUL at both ends."""
    return F.regexp_replace(text, r"^[ \t\n\r\x00\x0B]++|[ \t\n\r\x00\x0B]++$", "")


def line_of(text: Column, offset: Column) -> Column:
    """Line (from 1) of a code point offset."""
    before = text.substr(F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(text: Column, offset: Column) -> Column:
    """Column (from 1) of a code point offset."""
    before = text.substr(F.lit(1), offset)
    return (F.length(F.substring_index(before, "\n", -1)) + 1).cast("int")


def excerpt(text: Column, offset: Column, length: Column, radius: int = 32) -> Column:
    """The text around one word; the window keeps its width where it is clipped at the start."""
    begin = F.greatest(F.lit(0), offset - radius)
    return _excerpt(text, begin, begin, offset, length, F.length(text), radius)


def byte_levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance in UTF-8 bytes; over `most`: -1."""
    x, y = (F.decode(F.encode(c, "UTF-8"), "ISO-8859-1") for c in (a, b))
    return F.levenshtein(x, y, most) if most is not None else F.levenshtein(x, y)


def seed(context: Column) -> Column:
    """What identifies a context: by source, or all attributes in key order."""
    attribute = lambda name: F.coalesce(F.element_at(context["attributes"], name), F.lit(""))
    pairs = F.transform(F.array_sort(F.map_entries(context["attributes"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return (
        F.when(context["source"] == "translation", F.concat_ws("|", F.lit("translation"), attribute("locale"), attribute("domain"), attribute("key")))
        .when(context["source"] == "php", F.concat_ws("|", F.lit("php"), attribute("path"), attribute("kind"), attribute("identifier")))
        .otherwise(F.concat_ws("|", F.array_insert(pairs, 1, context["source"])))
    )


def fingerprint(seed_: Column, word: Column, kind: Column | str = "spelling") -> Column:
    """16 hex digits that stay when lines and columns move."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.substring(F.sha2(F.concat_ws("|", F.lit("v1"), seed_, F.lower(word), kind), 256), 1, 16)


def location_text(location: Column) -> Column:
    path, line, column = location["path"], location["line"], location["column"]
    where = F.concat(path, F.when(line.isNull(), "").otherwise(F.concat(F.lit(":"), line.cast("string"), F.when(column.isNull(), "").otherwise(F.concat(F.lit(":"), column.cast("string"))))))
    return F.coalesce(where, location["logical"], F.lit(""))


def deletions(word: Column, most: int = 2) -> Column:
    """All strings made from a word's UTF-8 bytes (as Latin-1 characters) by up to `most` deletions; two words within distance k share one."""
    s = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

    def once(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))

    out = F.array(s)
    layer = out
    for _ in range(most):
        layer = F.array_distinct(F.flatten(F.transform(layer, once)))
        out = F.array_distinct(F.concat(out, layer))
    return out
