"""Operator 2: benchmark decontamination by canonical templates.

Numbers (also written out, in four languages), names and the units that follow
numbers become typed placeholders, so that a question with other values keeps
its template. A name is a capitalised word that the benchmark never writes in
lower case, or any word after a title; both sides use the same rule. Windows
of ``window`` template words are hashed on both sides and hash-joined. Matches
on one alignment (document position less item position) of one item are
gathered, and their slots compared: each value of the item must stand against
one value of the document. Where it stands against several, only the windows
that hold it go, and of these those with the item's own values stay. A window
of which more than half are placeholders says little as a template; it is
hashed with its literal words, and only matches the same words.

An item counts as leaked into a document if consistent alignments cover
``min_coverage`` of its windows, or of those that are plain enough to match
with other values; or ``min_windows`` of them, as long as these are the share
``least_coverage`` of the item.

Words are read by ``PieceTable``: what lies between white space is parsed once
and then looked up. Where the benchmark has at most ``max_broadcast`` distinct
windows (8 bytes each, checked), their hashes are sent to all tasks and only
windows that hit are shuffled. A larger benchmark is joined by hash over the
shuffle; results are the same. The words that the benchmark writes in lower
case are sent too, the ``max_common`` most frequent.

Defined cases: null and empty texts hold no window, so neither a document nor
an item of fewer than 4 words can match; an item shorter than a window is one
window of its own length; rows with null ids match but give no row; repeated
rows give one row per (doc_id, item_id); empty tables give an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import pinned, small_batches, stage
from lexora.llm.pieces import HashIndex, PieceTable, held

_WORD = re.compile(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Words that are numbers by themselves, by language; articles and "one" only count after a number.
_UNITS_OF = {
    "en": "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen half third quarter dozen",
    "de": "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn",
    "fr": "deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize",
    "es": "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve",
}
_GREAT = {
    "en": "twenty thirty forty fifty sixty seventy eighty ninety hundred hundreds thousand thousands million millions billion billions",
    "de": "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen milliarde milliarden",
    "fr": "vingt vingts trente quarante cinquante soixante septante huitante nonante cent cents mille million millions milliard milliards",
    "es": "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos mil millón millones",
}
SPELLED = {w for words in (*_UNITS_OF.values(), *_GREAT.values()) for w in words.split()} | {"zero", "null", "zéro", "cero"}
GREAT = {w for words in _GREAT.values() for w in words.split()}
LATER = set("one un une uno una ein eins eine".split())
LINKS = set("and und et y".split())
TITLES = set("mr mrs ms miss dr prof herr frau señor señora monsieur madame mme sr sra".split())
UNITS = set(
    "km m cm mm mi mile miles meter meters metre metres kilometer kilometers foot feet ft inch inches yard yards kg g mg gram grams kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons l ml liter liters litre litres gallon gallons cup cups "
    "second seconds sec minute minutes min hour hours hr day days week weeks month months year years dollar dollars usd eur euro euros cent cents percent degrees degree mph kmh watt watts volt volts joule joules newton newtons byte bytes kb mb gb tb "
    "stunde stunden minuten tage jahre heures jours ans metros horas minutos días años".split()
)
NUMBER_FLAG, SPELLED_FLAG, NAME_FLAG, UNIT_FLAG, TITLE_FLAG, LINK_FLAG, LATER_FLAG, GREAT_FLAG = (1 << k for k in range(8))
_FLAGS = np.uint64(0xFF)
_NUM, _NAME, _UNIT = (np.uint64(c) for c in (0x9D39247E33776D00, 0x2AF7398005AAA500, 0x44DB015024623500))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Code of a slot's literal words, apart from all others.
_LITERAL = np.uint64(0xD1B54A32D192ED03)


@lru_cache(maxsize=1)
def _compound() -> re.Pattern:
    """German number words in one, and Spanish twenties."""
    unit = "(?:ein|eins|" + "|".join(_UNITS_OF["de"].split()) + ")"
    tens = "(?:" + "|".join(w for w in _GREAT["de"].split() if w.endswith("ig")) + ")"
    below = f"(?:{unit}und{tens}|{unit}|{tens})"
    hundreds = f"(?:{unit}?hundert(?:und)?{below}?|{below})"
    return re.compile(f"(?:{unit}und{tens}|{unit}?hundert(?:und)?{below}?|{hundreds}?tausend(?:und)?{hundreds}?|veinti(?:uno|ún|una|dós|trés|cuatro|cinco|séis|siete|ocho|nueve))")


def flags_of(word: str, capital: bool, common: frozenset[int], code: int) -> int:
    """What a lower-case word may stand for; code: its hash, as in common."""
    if word[0].isdigit():
        return NUMBER_FLAG
    if word in SPELLED:
        return SPELLED_FLAG | (GREAT_FLAG if word in GREAT else 0) | (UNIT_FLAG if word in UNITS else 0)
    if ("und" in word or "hundert" in word or "tausend" in word or word.startswith("veinti")) and _compound().fullmatch(word):
        return SPELLED_FLAG
    out = 0
    if word in UNITS:
        out |= UNIT_FLAG
    if word in TITLES:
        out |= TITLE_FLAG
    elif capital and code not in common:
        out |= NAME_FLAG
    if word in LINKS:
        out |= LINK_FLAG
    if word in LATER:
        out |= LATER_FLAG
    return out


def word_code(word: str) -> int:
    """A 56-bit hash, shifted up by 8."""
    import xxhash

    return xxhash.xxh64_intdigest(word, 7) & 0xFFFFFFFFFFFFFF00


def _learner(common: frozenset[int]):
    def learn(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for p in pieces:
            words = _WORD.findall(p.decode("utf-8"))
            for w in words:
                low = w.lower()
                code = word_code(low)
                flat.append(code | flags_of(low, w[0].isupper(), common, code))
            sizes.append(len(words))
        return np.array(flat, np.uint64), np.array(sizes, np.int64)

    return learn


def table_of(key, common: frozenset[int]) -> PieceTable:
    return held(("templates", key), lambda: PieceTable(_learner(common), np.uint64, b" \t\n\r", frugal=True), idle=2)


class Parsed:
    """Template words of texts: code (placeholders have fixed ones), literal code, the text of each, and the place of its first word among all words."""

    def __init__(self, texts: list[str], table: PieceTable):
        found, sizes = table.encode([t.encode("utf-8", "replace") for t in texts])
        text = np.repeat(np.arange(len(texts)), sizes)
        flags, literal = (found & _FLAGS).astype(np.int64), found & ~_FLAGS
        keep = self._runs(flags, text)
        self.first = np.flatnonzero(keep)
        flags, self.text = flags[keep], text[keep]
        # a run of number words has one code, made of all of them
        if len(self.first) < len(literal):
            mixed = literal.copy()
            np.multiply(mixed, _STEP + np.uint64(2), out=mixed, where=~keep)
            self.literal = np.add.reduceat(mixed, self.first) if len(self.first) else mixed
        else:
            self.literal = literal
        self.sizes = np.bincount(self.text, minlength=len(texts))
        number = (flags & (NUMBER_FLAG | SPELLED_FLAG)) > 0
        near = self.text[1:] == self.text[:-1]
        unit, name = np.zeros(len(flags), bool), (flags & NAME_FLAG) > 0
        unit[1:] = near & number[:-1] & ((flags[1:] & UNIT_FLAG) > 0) & ~number[1:]
        name[1:] |= near & ((flags[:-1] & TITLE_FLAG) > 0)
        self.codes = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, self.literal)))
        self.slot = number | unit | name

    @staticmethod
    def _runs(flags: np.ndarray, text: np.ndarray) -> np.ndarray:
        """False for words that go on a run of number words ("two hundred and five")."""
        keep = np.ones(len(flags), bool)
        if not (flags & SPELLED_FLAG).any():
            return keep
        spelled, great = (flags & SPELLED_FLAG) > 0, (flags & GREAT_FLAG) > 0
        goes_on = spelled | ((flags & LATER_FLAG) > 0)
        near = text[1:] == text[:-1]
        keep[1:] &= ~(near & spelled[:-1] & (spelled[1:] | (great[:-1] & goes_on[1:])))
        link = np.flatnonzero(near[:-1] & near[1:] & great[:-2] & ((flags[1:-1] & LINK_FLAG) > 0) & goes_on[2:]) + 1 if len(flags) > 2 else np.zeros(0, int)
        keep[link] = keep[link + 1] = False
        return keep

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the window that begins at each word, whether it is plain); only those that lie in one text count."""
        n = len(self.codes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = _hashed([self.codes[j : j + n] for j in range(size)])
        total = np.concatenate([[0], np.cumsum(self.slot)])
        heavy = np.flatnonzero(2 * (total[size:] - total[:-size]) > size)
        if len(heavy):
            out[heavy] = _hashed([np.where(self.slot[heavy + j], self.literal[heavy + j] * _LITERAL, self.codes[heavy + j]) for j in range(size)])
        plain = np.ones(n, bool)
        plain[heavy] = False
        return out, plain

    def inside(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.text[at] == self.text[at + size - 1]


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), np.uint64(len(columns)))
    for c in columns:
        out ^= out >> np.uint64(31)
        out *= _STEP
        out += c
    out ^= out >> np.uint64(29)
    return out


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


_SCHEMA = "row long, id long, hash long, pos long, slots array<string>, n long, plain boolean, n_plain long, size int"


def _windows(window: int, common, items: bool, hashes=None, sizes: tuple[int, ...] = ()):
    """(row, id, hash, pos, slots, number of windows, whether this one is plain, number of plain ones, words in it) of the windows of texts; with hashes only of those that are in it. Items shorter than a window are one window."""

    def run(batches):
        import pyarrow as pa

        table = table_of((len(common.value), hash(common.value)), common.value)
        known, flags = None, None
        if hashes is not None:
            known, flags = HashIndex(), np.zeros(1 << 22, bool)
            known.add(hashes.value)
            flags[(hashes.value >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            rows, ids, texts = (c.to_pylist() for c in batch.columns)
            out: list[list] = [[] for _ in range(9)]
            strings: dict[int, list[str]] = {}
            for a, b in _slices(texts):
                parsed = Parsed([t or "" for t in texts[a:b]], table)
                begin = np.cumsum(parsed.sizes) - parsed.sizes
                for size in sorted({window, *sizes}) if not items else sorted({window, *[int(s) for s in np.unique(parsed.sizes) if 4 <= s < window]}):
                    h, plain = parsed.windows(size)
                    at = np.flatnonzero(flags[(h >> np.uint64(42)).astype(np.int64)]) if flags is not None else np.arange(len(h))
                    at = at[known.find(h[at]) >= 0] if known is not None else at
                    at = at[parsed.inside(at, size)] if len(at) else at
                    if items and size < window:
                        at = at[parsed.sizes[parsed.text[at]] == size]
                    if not len(at):
                        continue
                    of = parsed.text[at]
                    n, n_plain = np.bincount(of, minlength=b - a), np.bincount(of[plain[at]], minlength=b - a)
                    for p, t in zip(at.tolist(), of.tolist()):
                        if a + t not in strings:
                            words = words_of(texts[a + t])
                            first = parsed.first[begin[t] : begin[t] + parsed.sizes[t]]
                            first = first - first[0] if len(first) else first
                            bounds = [*first.tolist(), len(words)]
                            strings[a + t] = [" ".join(words[x:y]) for x, y in zip(bounds, bounds[1:])]
                        own, k = strings[a + t], p - int(begin[t])
                        slots = [own[k + j] for j in np.flatnonzero(parsed.slot[p : p + size]).tolist()]
                        for column, v in zip(out, (rows[a + t], ids[a + t], 0, k, slots, int(n[t]), bool(plain[p]), int(n_plain[t]), size)):
                            column.append(v)
                    out[2][-len(at) :] = h[at].view(np.int64).tolist()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["row", "id", "hash", "pos", "slots", "n", "plain", "n_plain", "size"])

    return run


def _slices(texts: list[str | None], most: int = 1_000_000):
    """Bounds of runs of about `most` characters."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= most or k + 1 == len(texts):
            yield at, k + 1
            at, held = k + 1, 0


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(pinned(df)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def common_words(items: DataFrame, most: int) -> frozenset[int]:
    """Codes of the words that items write in lower case, the most frequent first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            codes = [word_code(w) for t in batch.column(0).to_pylist() for w in {w for w in _WORD.findall(t or "") if not w[0].isdigit() and w == w.lower()}]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(codes, np.uint64).view(np.int64))], ["code"])

    counts = items.select("text").mapInArrow(run, "code long").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return frozenset(r["code"] & 0xFFFFFFFFFFFFFFFF for r in counts.orderBy(F.desc("n"), "code").limit(most).collect())


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 6, min_windows: int = 8, least_coverage: float = 0.1, min_coverage: float = 0.5, max_broadcast: int = 2_000_000, max_common: int = 500_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, matched_windows, item_windows, coverage, kind (verbatim or reparameterised) of every leak."""
    items, context = _rows(benchmark, item_col, item_text_col), docs.sparkSession.sparkContext
    common = context.broadcast(common_words(items, max_common))
    bench = items.mapInArrow(_windows(window, common, True), _SCHEMA)
    bench = stage(bench.select(F.col("row").alias("item_row"), F.col("id").alias("item_id"), "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("n").alias("item_windows"), F.col("plain").alias("item_plain"), F.col("n_plain").alias("plain_windows"), "size"), "bench")
    rows = _rows(docs, id_col, text_col)
    distinct = bench.select("hash").distinct()
    sizes = tuple(r["size"] for r in bench.select("size").distinct().collect())  # at most one for each length up to the window
    known = None
    if distinct.count() <= max_broadcast:
        known = context.broadcast(np.array([r["hash"] for r in distinct.collect()], np.int64).view(np.uint64))
    hits = rows.mapInArrow(_windows(window, common, False, known, sizes), _SCHEMA).select("row", "id", "hash", "pos", "slots")
    met = hits.join(bench, "hash").where((F.size("slots") == F.size("item_slots")) & F.col("id").isNotNull() & F.col("item_id").isNotNull())
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # a set per alignment is bounded by the words of an item
    aligned = met.groupBy("row", "id", "item_row", "item_id", "item_windows", "plain_windows", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set(F.struct("item_pos", "item_plain", pairs.alias("pairs"))).alias("windows"))
    aligned = aligned.withColumn("pairs", F.array_distinct(F.flatten(F.transform("windows", lambda w: w["pairs"]))))
    equal = lambda p: p["a"] == p["b"]
    several = F.filter("pairs", lambda p: F.exists("pairs", lambda q: (q["a"] == p["a"]) & (q["b"] != p["b"])))
    aligned = aligned.withColumn("torn", F.transform(several, lambda p: p["a"]))
    aligned = aligned.withColumn("windows", F.filter("windows", lambda w: F.forall(w["pairs"], equal) | ~F.exists(w["pairs"], lambda p: F.array_contains("torn", p["a"]))))
    aligned = aligned.where(F.size("windows") > 0).withColumn("covered", F.transform("windows", lambda w: w["item_pos"])).withColumn("covered_plain", F.transform(F.filter("windows", lambda w: w["item_plain"]), lambda w: w["item_pos"]))
    same = F.forall("pairs", equal)
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("long")
    by_row = aligned.groupBy("row", "id", "item_row", "item_id", "item_windows", "plain_windows").agg(union("covered").alias("matched"), union("covered_plain").alias("matched_plain"), F.max_by(same, F.size("covered")).alias("same"))
    enough = ((F.col("matched") >= min_windows) & (F.col("matched") >= least_coverage * F.col("item_windows"))) | (F.col("matched") >= min_coverage * F.col("item_windows"))
    found = by_row.where(enough | ((F.col("matched_plain") > 0) & (F.col("matched_plain") >= min_coverage * F.col("plain_windows"))))
    out = found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max(F.struct((F.col("matched") / F.col("item_windows")).alias("coverage"), "matched", "item_windows", "same")).alias("best"))
    return out.select("doc_id", "item_id", F.col("best.matched").alias("matched_windows"), F.col("best.item_windows").alias("item_windows"), F.col("best.coverage").alias("coverage"), F.when(F.col("best.same"), "verbatim").otherwise("reparameterised").alias("kind"))
