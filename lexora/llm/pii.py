"""Operator 5 (native): personal data by weak supervision.

Candidates are found by regular expressions, strict ones (the base: e-mail,
IP address, payment card, phone) and loose ones (written-out e-mails, phones
without a plus, cards that fail a test). Labelers vote on each: the strict
rule, a gazetteer, context words on either side, and the shape. Expectation
maximisation over the table of vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data; on these soft labels
a logistic span classifier is trained, and decides on the loose candidates.
Base spans always stay.

All row work is DataFrame functions. What meets on the driver is a count per
vote pattern, at most 4 * 3**4 * 2 rows however large the corpus. Positions
are code points. Regular expressions are possessive where a text could make
them retry, and run only on texts that hold a sign they need.

Defined cases: a null or empty text has no spans (the digest is that of the
empty string); null ids pass through; repeated rows give repeated results;
with no candidates at all the written starting weights decide; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import stage, text_of

KINDS = ("email", "ip", "card", "phone")
#: \G: a match may also start where the one before ended; else only at the start of a run, as no later start in a run can match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-])",
}
NEEDS = {"email": "@", "phone": "+"}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|kontakt|courriel|address)\b",
    "ip": r"(?i)\b(?:ip|addr(?:ess)?|host|server|login|logged|from)\b",
    "card": r"(?i)\b(?:card|visa|master ?card|amex|credit|payment|tarjeta|karte|carte|cc)\b",
    "phone": r"(?i)\b(?:phone|tel(?:efon|efono|ephone)?|call|mobile|cell|fax|whatsapp|sms|contact|handy)\b",
}
AGAINST = r"(?i)\b(?:version|order|invoice|isbn|issn|serial|sku|part|build|token|hash|id|no|section|chapter)\b[^\n]{0,8}$"
GAZETTEER = {
    "email": r"(?i)(?:\.|dot\)?\]? ?)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl|example|test)\b|gmail|yahoo|hotmail|outlook|mail",
    "ip": r"^(?!0|127\.|255\.|169\.254\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|62)",
    "phone": r"^\+?(?:1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|^\([2-9]|^[2-9]",
}
LABELERS = ("strict", "gazetteer", "context", "shape")
SPAN = "struct<start:int,end:int,text:string>"
_EMPTY = f"array<{SPAN}>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their positions: lengths of what lies between, and of the matches, added up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("out"))
    return F.aggregate(pairs, first, step, lambda acc: acc["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _small(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(value) <= 3) & (value.cast("int") <= 255)


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), _small)
    digits = _digits(text)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _gate(kind: str, text: Column, loose: bool = False) -> Column:
    if kind in NEEDS and not loose:
        return F.contains(text, F.lit(NEEDS[kind]))
    if kind == "email":
        return F.contains(text, F.lit(" at ")) & F.contains(text, F.lit("dot")) | text.rlike(r"\[at\]|\(at\)")
    if kind == "card":  # candidates hold 7 digits at least, base spans 16
        return text.rlike("(?:[0-9][ -]?){6}[0-9]")
    return text.rlike("[0-9]{3}|[0-9]\\.[0-9]")


def _or_none(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.array().cast(_EMPTY))


def _clear(spans: Column, of: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(of, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def _votes(kind: str, text: Column, s: Column, strict: bool) -> Column:
    """0 or 1, or -1 for no vote, in the order of LABELERS."""
    before = F.substring(text, F.greatest(s["start"] - 39, F.lit(1)), F.least(s["start"], F.lit(40)))
    after = F.substring(text, s["end"] + 1, F.lit(20))
    cue = F.when(before.rlike(AGAINST), 0).when(before.rlike(CUES[kind]) | after.rlike(CUES[kind]), 1).otherwise(-1)
    edge = F.substring(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0)).rlike(r"[\p{L}\p{N}]") | F.substring(text, s["end"] + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    digits = F.length(_digits(s["text"]))
    shape = {"email": ~edge, "ip": ~edge & valid("ip", s["text"]), "card": ~edge & digits.between(13, 19), "phone": ~edge & digits.between(7, 15)}[kind]
    gaz = s["text"].rlike(GAZETTEER[kind])
    return F.struct(F.lit(1 if strict else 0).alias("strict"), gaz.cast("int").alias("gazetteer"), cue.alias("context"), shape.cast("int").alias("shape"))


def candidates(text: Column) -> list[Column]:
    """base_<kind> and loose_<kind> columns; text must be a column, as it is read often."""
    return [_or_none(_gate(k, text), matches(text, BASE[k])).alias(f"raw_{k}") for k in KINDS] + [_or_none(_gate(k, text, True), matches(text, LOOSE[k])).alias(f"more_{k}") for k in LOOSE]


def found(docs: DataFrame, text: str = "__text") -> DataFrame:
    """Adds arrays base_<kind> (spans) and maybe_<kind> (spans with votes) for each kind; docs must have the text column."""
    out = docs.select("*", *candidates(F.col(text)))
    for k in KINDS:
        out = out.withColumn(f"base_{k}", F.filter(f"raw_{k}", lambda s: valid(k, s["text"])))  # noqa: B023  used at once
    every = F.concat(*[F.col(f"base_{k}") for k in KINDS])
    for k in KINDS:
        rest = F.filter(f"raw_{k}", lambda s: ~valid(k, s["text"]) & F.length(_digits(s["text"])).between(7, 19)) if k in ("card", "phone") else F.array().cast(_EMPTY)
        out = out.withColumn(f"rest_{k}", _clear(F.concat(rest, F.col(f"more_{k}")) if k in LOOSE else rest, every))
    for k in KINDS:
        out = out.withColumn(
            f"maybe_{k}",
            F.concat(
                F.transform(f"base_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base"), _votes(k, F.col(text), s, True).alias("votes"))),
                F.transform(f"rest_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("base"), _votes(k, F.col(text), s, False).alias("votes"))),
            ),
        )
    return out.drop(*[f"{p}_{k}" for k in KINDS for p in ("raw", "rest")], *[f"more_{k}" for k in LOOSE])


@dataclass(frozen=True)
class SpanModel:
    """Logistic weights: base and one for each (labeler, vote); reliabilities as estimated."""

    weights: dict[str, tuple[float, ...]]
    reliability: dict[str, tuple[float, ...]]

    def keeps(self, kind: str, votes: Column) -> Column:
        w = self.weights[kind]
        z = F.lit(w[0])
        for j, name in enumerate(LABELERS):
            z = z + F.when(votes[name] == 1, w[1 + 2 * j]).when(votes[name] == 0, w[2 + 2 * j]).otherwise(0.0)
        return z >= 0


#: base, then (for, against) of each labeler
START = (-1.0, 3.0, -0.5, 0.7, -0.7, 1.6, -1.8, 0.8, -1.5)


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each pattern, P(vote is right | voted) for each labeler and class, prior), with labelers independent given the class."""
    right = np.full((votes.shape[1], 2), 0.8)
    prior = 0.5
    post = np.full(len(votes), 0.5)
    for _ in range(rounds):
        a, b = np.full(len(votes), math.log(prior)), np.full(len(votes), math.log(1 - prior))
        for j in range(votes.shape[1]):
            v = votes[:, j]
            a += np.where(v == 1, np.log(right[j, 1]), np.where(v == 0, np.log(1 - right[j, 1]), 0))
            b += np.where(v == 0, np.log(right[j, 0]), np.where(v == 1, np.log(1 - right[j, 0]), 0))
        post = 1 / (1 + np.exp(np.clip(b - a, -30, 30)))
        prior = float(np.clip((n @ post + 1) / (n.sum() + 2), 0.02, 0.98))
        for j in range(votes.shape[1]):
            v = votes[:, j]
            for c, q in ((1, post), (0, 1 - post)):
                said, hit = n @ (q * (v >= 0)), n @ (q * (v == c))
                right[j, c] = np.clip((hit + 4) / (said + 5), 0.55, 0.99)
    return post, right, prior


def fit(patterns: list[tuple[str, tuple[int, ...], int]]) -> SpanModel:
    """patterns: (kind, votes, how many candidates), over all documents."""
    weights, reliability = {}, {}
    for kind in KINDS:
        rows = sorted((v, n) for k, v, n in patterns if k == kind)
        if not rows:
            weights[kind], reliability[kind] = START, ()
            continue
        votes, n = np.array([v for v, _ in rows]), np.array([m for _, m in rows], float)
        post, right, _ = expectation_maximisation(votes, n)
        x = np.column_stack([np.ones(len(votes))] + [(votes[:, j] == side).astype(float) for j in range(votes.shape[1]) for side in (1, 0)])
        w, start = np.array(START), np.array(START)
        for _ in range(50):  # ridge towards the starting weights
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (post - p)) - (w - start))
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        weights[kind] = tuple(round(float(v), 6) for v in w)
        reliability[kind] = tuple(round(float(v), 4) for v in right.ravel())
    return SpanModel(weights, reliability)


def learn(spans: DataFrame) -> SpanModel:
    """spans: the maybe_<kind> columns of all documents."""
    each = F.concat(*[F.transform(f"maybe_{k}", lambda s: F.struct(F.lit(k).alias("kind"), s["votes"].alias("votes"))) for k in KINDS])
    counts = spans.select(F.explode(each).alias("c")).groupBy("c").count().collect()  # a row per kind and vote pattern
    return fit([(r["c"]["kind"], tuple(r["c"]["votes"][name] for name in LABELERS), r["count"]) for r in counts])


def accepted(kind: str, model: SpanModel) -> Column:
    """(start, end) of the base spans and of the loose ones that the classifier keeps, by start; of loose ones that overlap the first stays (none overlaps a base span)."""
    spans = F.filter(f"maybe_{kind}", lambda s: s["base"] | model.keeps(kind, s["votes"]))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    if kind != "phone":  # candidates of one pattern don't overlap
        return ordered

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(ordered, first, step, lambda acc: acc["out"])


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans of every document; one pass over the texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("__text"))
    spans = stage(found(rows).drop("__text"), "pii")
    model = learn(spans)
    base = F.concat(*[_named(k, F.col(f"base_{k}")) for k in KINDS])
    every = F.concat(*[_named(k, accepted(k, model)) for k in KINDS])
    return spans.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", marks: str = "<{}>") -> DataFrame:
    """docs with each accepted span of the text replaced by a mark of its kind; other columns stay as they are, whatever their names.

    Defined cases: a text without spans stays as it is, null or empty ones
    too; where spans overlap, one mark (of the first) stands for all that they
    cover; repeated rows give repeated results; an empty table stays empty.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), text_of(f"`{text_col}`").alias("__text"))
    model = learn(found(rows.select("__text")).drop("__text"))
    rows = found(rows)
    every = F.array_sort(F.concat(*[F.transform(accepted(k, model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(marks.format(k)).alias("mark"))) for k in KINDS]))
    rows = rows.withColumn("__spans", every)

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]  # a span that starts in the one before only moves the end
        kept = F.substring(F.col("__text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(kept, s["mark"]))).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate("__spans", first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.col("__text").substr(acc["at"] + 1, F.length("__text"))))
    clean = F.when(F.size("__spans") > 0, whole).otherwise(F.col(f"__row.`{text_col}`"))
    return rows.select(*[(clean if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in names])
