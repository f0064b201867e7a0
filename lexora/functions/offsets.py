"""Offset segments: array<struct<out,orig,len>> from a processed text back to the original; NULL is identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexora.functions.text import bound, running
from lexora.schema import OFFSETS


def blanked(text: Column, pattern: str) -> tuple[Column, Column]:
    """(text with each match as one space, segments of what is kept; NULL where nothing matches)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    every = F.split(text, pattern, -1)
    pieces = F.zip_with(every, hits, lambda g, h: F.struct(F.length(g).alias("kept"), F.coalesce(F.length(h), F.lit(0)).alias("lost")))

    def placed(p: Column) -> Column:
        # in the output each run is followed by one space
        outs, origs = running(F.transform(p, lambda x: x["kept"] + 1)), running(F.transform(p, lambda x: x["kept"] + x["lost"]))
        both = F.zip_with(outs, origs, lambda o, g: F.struct(o.alias("out"), g.alias("orig")))
        return F.filter(F.zip_with(both, p, lambda b, x: F.struct(b["out"].alias("out"), b["orig"].alias("orig"), x["kept"].alias("len"))), lambda s: s["len"] > 0)

    some = text.rlike(pattern)
    return F.when(some, F.array_join(every, " ")).otherwise(text), F.when(some, bound(pieces, placed))


def translate(segments: Column, offset: Column) -> Column:
    """Inside a segment by its shift; in a gap the end of the segment before; before all the first origin; NULL or empty: as is."""
    before = F.filter(segments, lambda s: s["out"] <= offset)
    last = F.element_at(before, -1)
    inside = F.when(offset < last["out"] + last["len"], last["orig"] + offset - last["out"]).otherwise(last["orig"] + last["len"])
    return F.when(segments.isNull() | (F.size(segments) == 0), offset).when(F.size(before) == 0, F.element_at(segments, 1)["orig"]).otherwise(inside).cast("int")


def compose(outer: Column, inner: Column) -> Column:
    """Segments of two steps together; inner is the later step. Runs that cross a gap are cut at it.

    A sweep over the starts and ends of both in the middle text: where both are open, the stretch up to the next event is a segment.
    """
    edge = lambda at, opens, which, shift: F.struct(at.alias("at"), F.lit(opens).alias("opens"), F.lit(which).alias("which"), shift.alias("shift"))
    edges = F.concat(
        F.flatten(F.transform(outer, lambda y: F.array(edge(y["out"], 1, 0, y["orig"] - y["out"]), edge(y["out"] + y["len"], 0, 0, F.lit(0))))),
        F.flatten(F.transform(inner, lambda x: F.array(edge(x["orig"], 1, 1, x["out"] - x["orig"]), edge(x["orig"] + x["len"], 0, 1, F.lit(0))))),
    )

    def stretches(e: Column) -> Column:
        last = lambda which: running(F.transform(e, lambda x, i: F.when(x["which"] == which, i).otherwise(-1)), lambda a, b: F.greatest(a, b), -1)
        both = F.zip_with(last(0), last(1), lambda a, b: F.struct(a.alias("outer"), b.alias("inner")))

        def stretch(x: Column, state: Column, i: Column) -> Column:
            before, back, ahead = F.get(e, i - 1), F.get(e, state["outer"]), F.get(e, state["inner"])
            open_ = (state["outer"] >= 0) & (state["inner"] >= 0) & (back["opens"] == 1) & (ahead["opens"] == 1)
            return F.when(open_, F.struct((before["at"] + ahead["shift"]).alias("out"), (before["at"] + back["shift"]).alias("orig"), (x["at"] - before["at"]).alias("len")))

        return F.filter(F.transform(both, lambda s, i: stretch(F.get(e, i), s, i)), lambda s: s["len"] > 0)

    cut = bound(F.array_sort(edges), stretches)
    return F.when(outer.isNull(), inner).when(inner.isNull(), outer).otherwise(cut)


def shift(segments: Column, delta: Column) -> Column:
    """Origins moved by delta."""
    return F.transform(segments, lambda s: F.struct(s["out"].alias("out"), (s["orig"] + delta).cast("int").alias("orig"), s["len"].alias("len")))


def normalize(segments: Column) -> Column:
    """Sorted, without empty segments, touching ones merged."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (last["out"] + last["len"] == s["out"]) & (last["orig"] + last["len"] == s["orig"])
        merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["out"].alias("out"), last["orig"].alias("orig"), (last["len"] + s["len"]).alias("len"))))
        return F.when(joins, merged).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.filter(F.array_sort(segments), lambda s: s["len"] > 0), F.array().cast(OFFSETS), step)


def single(length: Column, origin: Column) -> Column:
    """One run of a text from an origin."""
    return F.array(F.struct(F.lit(0).alias("out"), origin.cast("int").alias("orig"), length.cast("int").alias("len")))
