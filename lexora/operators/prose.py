"""Words of prose with their places, found over many texts at once in numpy.

What is a letter or a mark is asked of the JVM, so that words are those of
``patterns.PROSE``, which native expressions match.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as ST

LETTER, MARK, LINK = 1, 2, 3
#: Texts are scanned in groups of about so many characters, which bounds a worker's memory.
GROUP = 1 << 20
#: Rows of a batch that Spark sends, where the session has its default.
BATCH_ROWS = 1000
RADIUS = 32


@lru_cache(maxsize=1)
def _classes() -> bytes:
    """The class of each code point, compressed."""
    jvm = SparkSession.active()._jvm
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, "L"), (MARK, "M")):
        some = jvm.java.util.regex.Pattern.compile(rf"\P{{{name}}}+").matcher(every).replaceAll("")
        out[np.frombuffer(some.encode("utf-32-le"), np.uint32)] = kind
    out[[ord(c) for c in "'’-"]] = LINK
    return zlib.compress(out.tobytes())


@lru_cache(maxsize=1)
def _lowered() -> bytes:
    """The lower case of each code point by Spark, compressed; 0 where it is not one, or depends on what stands around."""
    spark = SparkSession.active()
    util, string = spark._jvm.org.apache.spark.sql.catalyst.util, spark._jvm.org.apache.spark.unsafe.types.UTF8String
    every = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000 and k != 10]
    icu = spark.conf.get("spark.sql.icu.caseMappings.enabled", "true") == "true"
    low = getattr(util, "CollationSupport$Lower").exec(string.fromString("\n".join(map(chr, every))), 0, icu).toString().split("\n")
    out = np.arange(0x110000, dtype=np.uint32)
    out[every] = [ord(c) if len(c) == 1 else 0 for c in low]
    out[0x3A3] = 0  # at the end of a word another sigma
    return zlib.compress(out.tobytes())


@lru_cache(maxsize=1)
def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


@lru_cache(maxsize=1)
def _lower_table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _cut(points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The stretches of points as strings."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    chars = points[np.arange(total) + np.repeat(begin - (ends - size), size)]
    data = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    if len(data) != total:
        widths = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(widths)])[ends]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _inside(kind: np.ndarray) -> np.ndarray:
    """Which characters are in a word: letters, marks that follow one, links between such and a letter."""
    out = kind == LETTER
    marks = np.flatnonzero(kind == MARK)
    if len(marks):
        heads = np.concatenate([[True], np.diff(marks) > 1])
        before = marks[heads] - 1
        out[marks] = ((before >= 0) & (kind[before] == LETTER))[np.cumsum(heads) - 1]
    links = np.flatnonzero(kind == LINK)
    links = links[(links > 0) & (links < len(kind) - 1)]
    out[links[out[links - 1] & (kind[links + 1] == LETTER)]] = True
    return out


def _lines(points: np.ndarray, starts: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, column), from 1, of places; `of` is the text of each, `starts` where the texts begin. Each text ends with a line break."""
    breaks = np.flatnonzero(points == 10)
    k = np.searchsorted(breaks, at)
    first = np.searchsorted(breaks, starts)
    last = np.where(k > 0, breaks[np.maximum(k - 1, 0)] if len(breaks) else -1, -1)
    return k - first[of] + 1, at - last


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, where each text begins, lengths); a line break ends each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return _points("\n".join(texts) + "\n"), np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]), sizes


def _bounds(points: np.ndarray, starts: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, index of its text) of the words."""
    step = np.diff(_inside(table[points]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long_ = end - begin >= least
    begin, size = begin[long_], (end - begin)[long_]
    return begin, size, np.searchsorted(starts, begin, "right") - 1


def count(texts: list[str], table: np.ndarray, lower: np.ndarray, least: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(index of its text, lower-cased word and how often it stands there) of the distinct words of each text."""
    points, starts, _ = _joined(texts)
    begin, size, of = _bounds(points, starts, table, least)
    low = lower[points]
    words = _cut(low, begin, size)
    odd = np.flatnonzero((low == 0) & (points != 0))
    if len(odd):
        at = np.searchsorted(begin, odd, "right") - 1
        at = np.unique(at[(at >= 0) & (odd < begin[at] + size[at])]) if len(begin) else at[:0]
        listed = words.to_pylist()
        for k, w in zip(at, _cut(points, begin[at], size[at]).to_pylist()):
            listed[k] = w.lower()
        words = pa.array(listed, pa.string())
    coded = words.dictionary_encode()
    several = max(1, len(coded.dictionary))
    each, n = np.unique(of * several + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return each // several, [coded.dictionary.take(pa.array(each % several)), pa.array(n)]


def scan(texts: list[str], table: np.ndarray, least: int, excerpts: bool, moved: list | None = None, originals: list[str] | None = None) -> tuple[np.ndarray, list[pa.Array]]:
    """(index of its text, columns of FIELDS) of the words of `least` characters or more; moved: segments of each text or None."""
    points, starts, sizes = _joined(texts)
    begin, size, of = _bounds(points, starts, table, least)
    index = np.arange(len(begin)) - np.searchsorted(of, np.arange(len(texts)))[of]
    line, column = _lines(points, starts, begin, of)
    offset, original_line = begin - starts[of], line
    if originals is not None:
        opoints, ostarts, osizes = _joined(originals)
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        for k, segments in enumerate(moved or []):
            if segments and bounds[k] < bounds[k + 1]:
                mine = slice(bounds[k], bounds[k + 1])
                out, orig, kept = (np.array([s[f] for s in segments], np.int64) for f in ("out", "orig", "len"))
                j = np.searchsorted(out, offset[mine], "right") - 1
                offset[mine] = np.where(j < 0, orig[0], orig[j] + np.minimum(offset[mine] - out[j], kept[j]))
        if any(moved or []):
            there = np.array([bool(s) for s in moved], bool)[of]
            oline, ocolumn = _lines(opoints, ostarts, offset + ostarts[of], of)
            original_line, column = np.where(there, oline, line), np.where(there, ocolumn, column)
    else:
        opoints, ostarts, osizes = points, starts, sizes
    out = [index, line, offset, original_line, column]
    columns = [*(pa.array(c.astype(np.int32)) for c in out), _cut(points, begin, size)]
    if excerpts:
        left = np.maximum(offset - RADIUS, 0)
        wide = np.maximum(np.minimum(size + 2 * RADIUS, osizes[of] - left), 0)
        columns += [_cut(opoints, left + ostarts[of], wide), pa.array(left > 0), pa.array(offset + size + RADIUS < osizes[of])]
    return of, columns


FIELDS = ("word_idx", "line", "offset", "original_line", "original_column", "word")
WINDOW = ("window", "cut_before", "cut_after")


def _batches(rows: DataFrame, kept: list[str], texts: list[str], fields: dict[str, ST.DataType], work) -> DataFrame:
    """The columns kept and fields: what work(columns of a group of texts) gives as (row of each, arrays)."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") in ("0", "10000"):  # the default; a chosen value stays
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))  # texts may be long
    given = rows.select(*kept, *[rows[c].alias(f"__{i}") for i, c in enumerate(texts)])
    schema = ST.StructType([*[given.schema[c] for c in kept], *[ST.StructField(f, t) for f, t in fields.items()]])
    n, names = len(kept), [*kept, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, first = 0, 0
            for last, size in enumerate(pc.fill_null(pc.utf8_length(batch.column(n)), 0).to_pylist(), 1):
                chars += size
                if chars < GROUP and last < batch.num_rows:
                    continue
                part = batch.slice(first, last - first)
                of, columns = work([part.column(n + i).to_pylist() for i in range(len(texts))])
                for at in range(0, len(of), 100_000):
                    taken = pa.array(of[at : at + 100_000])
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(taken) for i in range(n)), *(c.slice(at, 100_000) for c in columns)], names=names)
                chars, first = 0, last

    return given.mapInArrow(run, schema)


def _whole(texts: list) -> list[str]:
    return [t or "" for t in texts]


def words(rows: DataFrame, kept: list[str], least: int, text: str = "text", excerpts: bool = False, offsets: str | None = None, original: str | None = None) -> DataFrame:
    """A row per word: the columns kept, FIELDS and, on demand, the raw text around the word with whether it is cut (WINDOW). Lines and columns are those in the original, where there is one."""
    packed = _classes()
    types = [*[ST.IntegerType()] * 5, ST.StringType(), ST.StringType(), ST.BooleanType(), ST.BooleanType()]

    def work(columns: list[list]) -> tuple[np.ndarray, list[pa.Array]]:
        moved, originals = (columns[1], _whole(columns[2])) if offsets else (None, None)
        return scan(_whole(columns[0]), _table(packed), least, excerpts, moved, originals)

    return _batches(rows, kept, [c for c in (text, offsets, original) if c], dict(zip([*FIELDS, *(WINDOW if excerpts else ())], types)), work)


def counted(rows: DataFrame, kept: list[str], least: int, text: str = "text") -> DataFrame:
    """A row per distinct lower-cased word of a row: the columns kept, the word, and n, how often it stands there."""
    packed, lower = _classes(), _lowered()
    return _batches(rows, kept, [text], {"word": ST.StringType(), "n": ST.LongType()}, lambda columns: count(_whole(columns[0]), _table(packed), _lower_table(lower), least))
