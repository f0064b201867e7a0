"""The nearest entries of a dictionary to many words: deletion neighbourhoods as hashes in numpy, block by block.

Words and entries of a block share the first character. A task holds a slice
of a block's entries with their neighbourhoods, of a bounded size, and a slice
of its words; what is made for a pair of slices stays in the task, but for the
best of each word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tails of at most so many bytes are found by neighbourhoods; a longer one is compared with all entries of about its length.
LONGEST = 64
#: Neighbourhood strings of the entries in a slice, words in a slice, and strings or pairs that are looked at together; they bound a task's memory.
SLICE_KEYS, SLICE_WORDS, TOGETHER = 4_000_000, 50_000, 1_000_000
FOUND = "word string, best array<struct<distance:int,length:int,pos:bigint,candidate:string>>"
_FOUND = pa.schema([("word", pa.string()), ("best", pa.list_(pa.struct([("distance", pa.int32()), ("length", pa.int32()), ("pos", pa.int64()), ("candidate", pa.string())])))])


@lru_cache(maxsize=1)
def _hashing() -> tuple[np.ndarray, np.ndarray, np.uint64, np.uint64]:
    """A random number for each byte, powers of an odd base, its inverse, and the square of that; all modulo 2**64."""
    random = np.random.default_rng(42)
    base = int(random.integers(1 << 62)) * 2 + 1
    powers = np.array([pow(base, k, 1 << 64) for k in range(LONGEST + 8)], np.uint64)
    inverse = pow(base, -1, 1 << 64)
    return random.integers(1, 1 << 63, 256, np.uint64), powers, np.uint64(inverse), np.uint64(inverse * inverse % (1 << 64))


def keys(tails: np.ndarray, distance: int) -> np.ndarray:
    """Hashes of what is left of each tail (a row of bytes) after up to `distance` deletions, 2 at most."""
    values, powers, inverse, square = _hashing()
    n = tails.shape[1]
    before = np.zeros((len(tails), n + 1), np.uint64)
    np.cumsum(values[tails] * powers[:n], axis=1, out=before[:, 1:])
    whole = before[:, n:]
    out = [whole]
    if distance and n:
        out.append(before[:, :n] + (whole - before[:, 1:]) * inverse)
    if distance > 1 and n > 1:
        i, j = np.triu_indices(n, 1)
        out.append(before[:, i] + (before[:, j] - before[:, i + 1]) * inverse + (whole - before[:, j + 1]) * square)
    return np.concatenate(out, axis=1)


def _padded(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)


def distances(a: np.ndarray, b: np.ndarray, n: int, sizes: np.ndarray, most: int) -> np.ndarray:
    """Levenshtein distances of rows of n bytes and rows of `sizes` bytes (padded, n + most columns or more), right up to `most`; sizes differ from n by that at most."""
    far = np.int8(most + 1)
    band = [np.full(len(a), abs(d) if d >= 0 else far, np.int8) for d in range(-most, most + 1)]
    for i in range(1, n + 1):
        new: list[np.ndarray] = []
        for d in range(-most, most + 1):
            j, k = i + d, d + most
            if j < 0:
                new.append(np.full(len(a), far, np.int8))
                continue
            if j == 0:
                new.append(np.full(len(a), min(i, most + 1), np.int8))
                continue
            cell = band[k] + (a[:, i - 1] != b[:, j - 1])
            if k + 1 < len(band):
                cell = np.minimum(cell, band[k + 1] + np.int8(1))
            if k:
                cell = np.minimum(cell, new[k - 1] + np.int8(1))
            new.append(np.minimum(cell, far).astype(np.int8))
        band = new
    return np.stack(band)[sizes - n + most, np.arange(len(a))]


class Entries:
    """A slice of the entries of a block, with the neighbourhoods of the shorter ones."""

    def __init__(self, entries: list[str], pos: list[int], distance: int) -> None:
        self.distance = distance
        pairs = sorted((e.encode("utf-8", "surrogatepass"), e, p) for e, p in zip(entries, pos))  # so that a place tells the order of bytes
        self.texts = [e for _, e, _ in pairs]
        self.pos = np.array([p for _, _, p in pairs], np.int64)
        self.chars = np.array([len(e) for e in self.texts], np.int64)
        self.tails = [b[len(e[:1].encode("utf-8", "surrogatepass")) :] for b, e, _ in pairs]
        self.sizes = np.array([len(t) for t in self.tails], np.int64)
        self.width = LONGEST + 2 * distance
        short = self.sizes <= LONGEST + distance
        self.padded = _padded([t if s else b"" for t, s in zip(self.tails, short)], self.width)
        found, ids = [], []
        for m in np.unique(self.sizes[short]):
            at = np.flatnonzero(self.sizes == m)
            k = keys(self.padded[at, :m], distance)
            found.append(k.ravel())
            ids.append(np.repeat(at.astype(np.int32), k.shape[1]))
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(every)
        self.keys, self.ids = every[order], (np.concatenate(ids) if ids else np.zeros(0, np.int32))[order]

    def pairs(self, tails: np.ndarray):
        """(row of tails, entry) of those that share a neighbourhood, some rows at a time."""
        n = tails.shape[1]
        step = max(1, TOGETHER // (1 + n + n * (n - 1) // 2))
        for first in range(0, len(tails), step):
            k = keys(tails[first : first + step], self.distance)
            width, flat = k.shape[1], k.ravel()
            low = np.searchsorted(self.keys, flat)
            hit = np.flatnonzero((low < len(self.keys)) & (self.keys[np.minimum(low, max(0, len(self.keys) - 1))] == flat)) if len(self.keys) else np.zeros(0, np.int64)
            low, count = low[hit], np.searchsorted(self.keys, flat[hit], "right") - low[hit]
            ends = np.cumsum(count)
            at = 0
            while at < len(hit):  # what is found is as much as the texts have it, so that it is taken in parts of whole rows
                to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right"))
                to = int(np.searchsorted(hit // width, hit[max(to, at + 1) - 1] // width, "right"))
                c = count[at:to]
                row = np.repeat(hit[at:to] // width, c)
                entry = self.ids[np.repeat(low[at:to] - np.cumsum(c) + c, c) + np.arange(c.sum())]
                both = np.unique(row * len(self.texts) + entry)
                yield first + both // len(self.texts), both % len(self.texts)
                at = to

    def best(self, rows: np.ndarray, entry: np.ndarray, how: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first `most` of each row: by distance, length, position and bytes."""
        order = np.lexsort((entry, self.pos[entry], self.chars[entry], how, rows))
        rows, entry, how = rows[order], entry[order], how[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < most
        return rows[kept], entry[kept], how[kept]


def nearest(words: list[str], entries: Entries, most: int):
    """(index of the word, entry, distance) of the best of each word, in parts; words share the first character of the entries."""
    distance = entries.distance
    coded = [w[1:].encode("utf-8", "surrogatepass") for w in words]
    sizes, chars = np.array([len(t) for t in coded], np.int64), np.array([len(w) for w in words], np.int64)

    def near(at: np.ndarray, entry: np.ndarray, a: np.ndarray, b: np.ndarray, n: int):
        """at: the words of rows a, in order; entry: those of rows b."""
        how = distances(a, b, n, entries.sizes[entry], distance)
        ok = (how <= distance) & (np.abs(chars[at] - entries.chars[entry]) <= distance)
        return entries.best(at[ok], entry[ok], how[ok], most)

    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        if n <= LONGEST:
            tails = np.frombuffer(b"".join(coded[i] for i in at), np.uint8).reshape(len(at), n)
            for row, entry in entries.pairs(tails):
                close = np.abs(entries.sizes[entry] - n) <= distance
                row, entry = row[close], entry[close]
                yield near(at[row], entry, tails[row], entries.padded[entry], int(n))
            continue
        like = np.flatnonzero(np.abs(entries.sizes - n) <= distance)
        step = max(1, TOGETHER * 16 // int(n))
        for i in at if len(like) else ():
            found = []
            for some in (like[k : k + step] for k in range(0, len(like), step)):
                a = np.broadcast_to(np.frombuffer(coded[i], np.uint8), (len(some), n))
                found.append(near(np.full(len(some), i), some, a, _padded([entries.tails[k] for k in some], int(n) + distance), int(n)))
            yield entries.best(*map(np.concatenate, zip(*found)), most)


def _table(words: list[str], entries: Entries, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    row, entry, how = found
    heads = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
    each = pa.StructArray.from_arrays([pa.array(how.astype(np.int32)), pa.array(entries.chars[entry].astype(np.int32)), pa.array(entries.pos[entry]), pa.array([entries.texts[k] for k in entry], pa.string())], names=["distance", "length", "pos", "candidate"])
    return pa.Table.from_arrays([pa.array([words[k] for k in row[heads]], pa.string()), pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)).astype(np.int32)), each)], schema=_FOUND)


def top(words: DataFrame, entries: DataFrame, distance: int, most: int) -> DataFrame:
    """word, suggestions of distinct words(word) by distinct entries(candidate, pos) within 1 or 2 byte edits that share the first character."""
    first = lambda c: F.substring(c, 1, 1).alias("block")
    size = F.least(F.octet_length("candidate"), F.lit(LONGEST + distance + 4))
    held = entries.groupBy(first("candidate")).agg(F.sum(1 + size + size * (size - 1) / 2).alias("keys"))
    asked = words.groupBy(first("word")).agg(F.count(F.lit(1)).alias("words"))
    up = lambda c, n: F.ceil(F.col(c) / n).cast("int").alias(c)
    rows = held.join(asked, "block").select("block", up("keys", SLICE_KEYS), up("words", SLICE_WORDS)).collect()  # a row per first character
    spark = words.sparkSession
    if not rows:
        return spark.createDataFrame([], "word string, suggestions array<string>")
    slices = F.broadcast(spark.createDataFrame(rows, "block string, n int, m int"))  # slices of entries, of words
    groups = sum(r["keys"] * r["words"] for r in rows)
    tasks = max(1, min(groups, 2 * max(spark.sparkContext.defaultParallelism, sum(r["keys"] * r["words"] for r in rows if r["words"] > 1))))
    by = ["block", "i", "j"]
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = words.withColumn("block", first("word")).join(slices, "block").select("block", mine("word", "m").alias("j"), every("n").alias("i"), "word").repartition(tasks, *by)
    right = entries.withColumn("block", first("candidate")).join(slices, "block").select("block", mine("candidate", "n").alias("i"), every("m").alias("j"), "candidate", "pos").repartition(tasks, *by)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _FOUND.empty_table()
        mine, there = a.column("word").to_pylist(), Entries(b.column("candidate").to_pylist(), b.column("pos").to_pylist(), distance)
        return pa.concat_tables([_FOUND.empty_table(), *(_table(mine, there, f) for f in nearest(mine, there, most))])

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, FOUND)
    best: Column = F.col("best")
    if any(r["keys"] > 1 for r in rows):  # entries of a block are in several slices
        found, best = found.groupBy("word").agg(F.flatten(F.collect_list("best")).alias("best")), F.slice(F.array_sort("best"), 1, most)
    return found.select("word", F.transform(best, lambda s: s["candidate"]).alias("suggestions"))
