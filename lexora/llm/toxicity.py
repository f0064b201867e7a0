"""Operator 10: toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs and accents to Latin letters,
and digits or signs that stand for letters inside a word. One automaton finds
lexicon words and exception phrases ("trash can"); a word inside an exception
phrase, or inside a longer word, does not count. The summed weight, and the
same normalised by length, go through a logistic function.

The lexicon starts from a small written list; labelled rows of the training
folds reweight it and add words that are far more frequent in toxic texts.
Labels are read from at most ``max_train`` labelled rows, chosen by hash of
the id; every document is scored from its whole text.

Defined cases: null and empty texts score like a text without any match; null
ids are scored and not held out; where no labelled row of a class is found the
written weights are used; equal ids in labels are toxic if one of them is;
repeated rows give repeated results; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexora.llm.common import crc32_mod4, fresh, small_batches, stage, unstage

SEEDS = "idiot moron stupid scum loser clown trash pathetic worthless disgusting imbecile dumb dimwit pig vermin filth bastard bitch asshole shit fuck cretin halfwit jerk degenerate subhuman retard creep parasite garbage".split()
SEED_WEIGHT = 2.0
EXCEPTIONS = [
    "trash can", "trash cans", "trash bin", "trash bag", "clown fish", "circus clown", "loser bracket", "loser s bracket", "guinea pig", "guinea pigs", "pig iron", "pond scum",
    "dumb bell", "dumb bells", "garbage collection", "garbage collector", "garbage can", "garbage truck", "garbage bag", "knee jerk", "jerk chicken", "degenerate case", "degenerate matter",
]
_GLYPHS = dict(zip("аеорсухіјѕԁһӏвмтнкαοιεκνρτυχβηζ", "aeopcyxijsdhlbmtnkaoieknptuxbnz"))
_SIGNS = dict(zip("013456789@$!|", "oieasgtbgasil"))
_SUSPECT = re.compile(r"[a-z][0-9@$!|]+[a-z]|(?<![^\W\d_])[0-9@$!|]+[a-z]{2}|[a-z][0134578]+(?![\w@$!|])")
_TOKEN = re.compile(r"(?<![\w@$!|])[\w@$!|]*[a-z][\w@$!|]*")
_WORD = re.compile(r"[a-z]+")


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    """One character for one: positions stay as they were."""
    out = {ord(k): v for k, v in _GLYPHS.items()} | {0x131: "i", 0x142: "l", 0xF8: "o", 0xDF: "s"}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x24B6, 0x24EA), *range(0x1D400, 0x1D6A4)]:
        base = unicodedata.normalize("NFKD", chr(c))[:1].lower()
        if c not in out and base.isascii():
            out[c] = base
    for c in (0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF, *range(0x300, 0x370)):
        out[c] = ""
    return out


def _fold_token(m: re.Match) -> str:
    token = m[0]
    letters = token.rstrip("!|$@")
    if not any(c in _SIGNS for c in letters) or letters.isalpha():
        return token
    if sum(c.isalpha() for c in letters) < 2:
        return token
    return "".join(_SIGNS.get(c, c) for c in letters) + token[len(letters) :]


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = text.translate(_table())
    if _SUSPECT.search(text):
        text = _TOKEN.sub(_fold_token, text)
    return text


@dataclass(frozen=True)
class Model:
    """weights of the lexicon, exception phrases, and the logistic coefficients (base, any, sum, density)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, ...]

    def matcher(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            automaton.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            automaton.add_word(phrase, (len(phrase), None))
        automaton.make_automaton()
        return automaton

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x @ np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def matches(automaton, text: str) -> tuple[float, int]:
    """(summed weight, matches) in a folded text: whole words, outside of exception phrases."""
    found, shields = [], []
    for end, (size, weight) in automaton.iter(text):
        start = end - size + 1
        if (start and text[start - 1].isalpha()) or (end + 1 < len(text) and text[end + 1].isalpha()):
            continue
        (shields if weight is None else found).append((start, end, weight))
    if shields:
        found = [f for f in found if not any(a <= f[0] and f[1] <= b for a, b, _ in shields)]
    return sum(f[2] for f in found), len(found)


def row(automaton, text: str | None) -> tuple[float, float, float, float]:
    text = fold(text or "")
    total, _ = matches(automaton, text)
    words = max(1, text.count(" ") + text.count("\n") + 1)
    return 1.0, float(total > 0), math.log1p(total), total / math.sqrt(words)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the base."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


DEFAULT = (-4.0, 3.0, 1.0, 0.5)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 20_000, least: int = 5) -> Model:
    """max_train bounds the labelled rows read; a learned word occurs in `least` toxic rows or more, and far more often than in others."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(crc32_mod4("doc_id") != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))  # at most max_train rows of 12 bytes
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(picked, "doc_id").select("text", "y")

    def count(batches):
        import pyarrow as pa

        bad, good = Counter(), Counter()
        n = [0, 0]

        def out():
            words = sorted({*bad, *good})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([bad[w] for w in words], pa.int64()), pa.array([good[w] for w in words], pa.int64())], ["word", "bad", "good"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[0 if y else 1] += 1
                (bad if y else good).update(set(_WORD.findall(fold(text or ""))))
            if len(bad) + len(good) > 200_000:
                yield from out()
                bad.clear(), good.clear()
        bad["\x00"], good["\x00"] = n
        yield from out()

    counts = stage(rows.mapInArrow(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "counts")
    first = counts.where(F.col("word") == "\x00").first()
    n_bad, n_good = (first["bad"], first["good"]) if first else (0, 0)
    weights = {w: SEED_WEIGHT for w in SEEDS}
    if n_bad and n_good:
        gain = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
        error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
        marked = (gain > 3) & (gain / error > 4) & (F.col("bad") > 3 * F.col("good")) & (F.length("word") >= 3) & (F.col("bad") >= least)
        # words of at most max_train rows that hardly stand in others
        got = counts.withColumn("gain", gain).where((F.col("word") != "\x00") & (F.col("word").isin(SEEDS) & (F.col("bad") >= least) | marked)).orderBy("word").collect()
        for r in got:
            weights[r["word"]] = max(0.0, r["gain"]) if r["word"] not in weights or r["bad"] + r["good"] >= 20 else max(SEED_WEIGHT / 2, r["gain"])
    unstage(counts)
    weights = {w: round(v, 4) for w, v in weights.items() if v > 0}
    model = Model(weights, tuple(EXCEPTIONS), DEFAULT)
    if not min(n_bad, n_good):
        return model

    def feature(batches):
        import pyarrow as pa

        automaton = model.matcher()
        for batch in batches:
            x = np.array([row(automaton, t) for t in batch.column(0).to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in (1, 2, 3)] + [batch.column(1).cast(pa.float64())], ["a", "b", "c", "y"])

    data = np.array([tuple(r) for r in rows.mapInArrow(feature, "a double, b double, c double, y double").collect()], float)  # max_train rows of four numbers
    w = fit_logistic(np.column_stack([np.ones(len(data)), data[:, :3]]), data[:, 3])
    return Model(weights, tuple(EXCEPTIONS), tuple(float(v) for v in w))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep_as: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; with keep_as all columns of docs, and the score under that name."""
    parameters, docs = model, small_batches(docs)

    def run(batches):
        import pyarrow as pa

        automaton = parameters.matcher()
        for batch in batches:
            x = np.array([row(automaton, t) for t in batch.column(batch.num_columns - 1).to_pylist()], float).reshape(-1, 4)
            s = pa.array(parameters.score(x))
            if keep_as:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], s], names=[*batch.schema.names[:-1], keep_as])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), s], ["doc_id", "score"])

    text = F.col(f"`{text_col}`").cast("string").alias(fresh(docs, "text"))
    if keep_as:
        return docs.select("*", text).mapInArrow(run, StructType([*docs.schema.fields, StructField(keep_as, DoubleType())]))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc32_mod4("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
