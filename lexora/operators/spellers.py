"""Spellers: word tables in, unknown words with suggestions out.

A speller takes words(language, word) and returns the unknown ones; every
check runs on distinct lower-cased words and is joined back.
"""

from __future__ import annotations

import os
import re
import select
import subprocess
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.errors import SpellerNotAvailable, SpellerProcessError
from lexora.functions import text as T
from lexora.operators import nearest
from lexora.staging import stage, unstage

MAX_DISTANCE, MAX_SUGGESTIONS = 2, 3
#: A dictionary of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: A dictionary of at most this many rows is looked up in packed buckets, about 40 bytes a row.
LOOKUP_ROWS = 3_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its row count, which is taken, allows it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _entry(language: Column, word: Column) -> Column:
    return F.concat_ws("\0", language, word)


def lacking(words: DataFrame, known: DataFrame, word: str = "word") -> DataFrame:
    """Rows of words(language, ...) whose lower-cased word is not in known(language, word).

    Up to LOOKUP_ROWS rows are broadcast, packed in buckets by hash: an eighth of the rows, without a row's overhead for each
    word. So words stay where they are; only with a larger dictionary are they joined by shuffle.
    """
    known = known.select("language", F.col("word").alias("__lower")).where("language is not null and __lower is not null")
    count = known.limit(LOOKUP_ROWS + 1).count()
    rows = words.withColumn("__lower", F.lower(word))
    if count > LOOKUP_ROWS:
        return rows.join(known.distinct().hint("merge"), ["language", "__lower"], "left_anti").select(*words.columns)
    bucket = F.pmod(F.xxhash64("language", "__lower"), F.lit(max(1, count // 8))).alias("__bucket")
    packed = known.groupBy(bucket).agg(F.collect_set(_entry(F.col("language"), F.col("__lower"))).alias("__entries"))
    met = rows.withColumn("__bucket", bucket).join(F.broadcast(packed), "__bucket", "left")
    hit = F.col("language").isNotNull() & F.array_contains("__entries", _entry(F.col("language"), F.col("__lower")))
    return met.where(~F.coalesce(hit, F.lit(False))).select(*words.columns)


def compounds(missing: DataFrame, known: DataFrame) -> DataFrame:
    """(language, word) of the words(language, word) with two or more parts, all of them in known."""
    joined = missing.select("language", F.lower("word").alias("whole")).where(F.col("whole").rlike("['-]")).distinct()
    parts = joined.select("language", "whole", F.explode(F.filter(F.split("whole", "['-]"), lambda p: F.length(p) > 1)).alias("word"))
    several = parts.groupBy("language", "whole").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("language", F.col("whole").alias("word"))
    return several.join(lacking(parts, known).select("language", F.col("whole").alias("word")).distinct(), ["language", "word"], "left_anti")


def accepted(words: DataFrame, known: DataFrame) -> DataFrame:
    """(language, word): what is known, and the compounds of known parts among words(language, word); staged."""
    known = known.select("language", "word")
    return stage(known.unionByName(compounds(lacking(words.select("language", "word"), known), known)), "accepted")


def unknown(words: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of words(language, word, ...) that are neither in known(language, word) nor compounds of known parts."""
    return lacking(words, accepted(words, known))


def suggestions(words: DataFrame, dictionary: DataFrame, distance: int = MAX_DISTANCE, most: int = MAX_SUGGESTIONS) -> DataFrame:
    """word, suggestions (array, best first) for distinct lower-cased words(word); dictionary(word, pos).

    Candidates share the first letter, differ in length by `distance` at most
    and are within that many byte edits. They are found by deletion
    neighbourhoods, which lose none, in place of comparing all words of a
    block; ties go to the shorter, then to the earlier in the dictionary.
    """
    lower = words.select(F.lower("word").alias("word")).where("word is not null").distinct()
    entries = dictionary.select(F.lower("word").alias("candidate"), "pos").where("candidate is not null").groupBy("candidate").agg(F.min("pos").alias("pos"))
    if distance in (1, 2):
        lower, entries = stage(lower, "asked"), stage(entries, "entries")  # they are counted first
        return nearest.top(lower, entries, distance, most)
    # both share the first letter, so it is part of the key
    key = lambda c: F.explode(F.transform(T.deletions(F.col(c), distance), lambda d: F.concat(F.substring(c, 1, 1), F.lit(":"), d))).alias("key")
    left, right = lower.select("word", key("word")), entries.select("candidate", "pos", key("candidate"))
    # a neighbourhood is many times its word, which the planner doesn't see: never to the driver
    pairs = left.join(right.hint("merge"), "key").where(F.abs(F.length("word") - F.length("candidate")) <= distance)
    pairs = pairs.select("word", "candidate", "pos").distinct().withColumn("distance", T.byte_levenshtein(F.col("word"), F.col("candidate"))).where(F.col("distance") <= distance)
    order = Window.partitionBy("word").orderBy("distance", F.length("candidate"), "pos", "candidate")
    top = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda s: s["candidate"]).alias("suggestions"))


def apply_case(reference: Column, suggestion: Column) -> Column:
    first = F.substring(reference, 1, 1)
    capital = F.concat(F.upper(F.substring(suggestion, 1, 1)), suggestion.substr(F.lit(2), F.length(suggestion)))
    return F.when((reference == F.upper(reference)) & (F.length(reference) > 1), F.upper(suggestion)).when((first == F.upper(first)) & (first != F.lower(first)), capital).otherwise(F.lower(suggestion))


def formatted(word: Column, found: Column, parent: Column, most: int = MAX_SUGGESTIONS) -> Column:
    """Suggestions put into the identifier they come from, in the word's case; plain ones where there is no parent."""
    at = F.call_function("locate", word, parent)

    def spliced(s: Column) -> Column:
        cased = apply_case(word, s)
        return F.when(at == 0, cased).otherwise(F.concat(parent.substr(F.lit(1), at - 1), cased, parent.substr(at + F.length(word), F.length(parent))))

    inside = F.array_distinct(F.transform(F.filter(found, lambda s: ~F.contains(s, F.lit(" "))), spliced))
    plain = parent.isNull() | (parent == word) | (parent == "") | (F.size(inside) == 0)
    return F.when(plain, F.slice(found, 1, most)).otherwise(F.slice(inside, 1, most))


@dataclass
class WordListSpeller:
    """dictionary(word, language, pos); suggestions come from all its languages. It takes any language, unless it is only for some."""

    dictionary: DataFrame
    max_suggestions: int = MAX_SUGGESTIONS
    max_distance: int = MAX_DISTANCE
    only: tuple[str, ...] = ()
    name: str = "wordlist"

    def is_available(self) -> bool:
        return True

    def languages(self) -> list[str]:
        return list(self.only)

    def supports(self, language: str) -> bool:
        return not self.only or language in self.only

    def describe(self) -> str:
        return f"{self.dictionary.count()} words"

    def check(self, words: DataFrame, with_suggestions: bool = True) -> DataFrame:
        """Unknown rows of words(language, word, ...) with suggestions."""
        from lexora.operators.dictionary import for_languages

        # one pass over the words, which may be dear; the rest is asked of the distinct ones
        vocabulary = stage(words.select("language", F.lower("word").alias("word")).distinct(), "vocabulary")
        spoken = sorted(r[0] for r in vocabulary.select("language").where("language is not null").distinct().collect())
        good = accepted(vocabulary, stage(for_languages(self.dictionary, spoken), "known"))
        missing = lacking(words, good)
        if not with_suggestions or not self.max_suggestions:
            return missing.withColumn("suggestions", F.array().cast("array<string>"))
        best = suggestions(lacking(vocabulary, good), self.dictionary, self.max_distance, self.max_suggestions).withColumnRenamed("word", "__lower")
        out = missing.withColumn("__lower", F.lower("word")).join(best, "__lower", "left").drop("__lower")
        return out.withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))


@dataclass
class NullSpeller:
    """Accepts everything: what a run costs without a check."""

    name: str = "null"

    def is_available(self) -> bool:
        return True

    def languages(self) -> list[str]:
        return []

    def supports(self, language: str) -> bool:
        return True

    def describe(self) -> str:
        return "null: accepts every word"

    def check(self, words: DataFrame, with_suggestions: bool = True) -> DataFrame:
        return words.where(F.lit(False)).withColumn("suggestions", F.array().cast("array<string>"))


def cache_key(config_hash: str, language: Column, word: Column, with_suggestions: bool = True) -> Column:
    return F.concat(F.lit("sc_"), F.substring(F.sha2(F.concat_ws("\0", F.lit(config_hash), language, F.lit("1" if with_suggestions else "0"), F.lower(word)), 256), 1, 40))


@dataclass
class CachingSpeller:
    """Checks each distinct lower-cased word once, keeps results (also that a word is known) in a Parquet table, and fans them out.

    ttl: seconds after which a result is asked for again; 0 keeps it for ever.
    A speller in its own right: languages and availability are those of inner.
    """

    inner: object
    path: str
    config_hash: str = ""
    ttl: int = 0
    hits: int = 0
    misses: int = 0

    @property
    def name(self) -> str:
        return self.inner.name

    def is_available(self) -> bool:
        return self.inner.is_available()

    def languages(self) -> list[str]:
        return self.inner.languages()

    def supports(self, language: str) -> bool:
        return self.inner.supports(language)

    def describe(self) -> str:
        return f"{self.inner.describe()} (cached)"

    def _cached(self, spark) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            rows = spark.read.parquet(self.path)
        except AnalysisException:  # no cache yet
            return spark.createDataFrame([], "cache_key string, is_known boolean, suggestions array<string>, stored_at timestamp")
        if self.ttl > 0:
            rows = rows.where(F.col("stored_at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(self.ttl)))
        # a key is stored again when its time is over
        return rows.groupBy("cache_key").agg(F.max_by(F.struct("is_known", "suggestions"), "stored_at").alias("r"), F.max("stored_at").alias("stored_at")).select("cache_key", "r.*", "stored_at")

    def check(self, words: DataFrame, with_suggestions: bool = True) -> DataFrame:
        spark = words.sparkSession
        keyed = words.withColumn("cache_key", cache_key(self.config_hash, F.col("language"), F.col("word"), with_suggestions))
        # the representative of a key is its smallest spelling
        asked = keyed.groupBy("cache_key").agg(F.min(F.struct("word", "language")).alias("r")).select("cache_key", "r.word", "r.language")
        asked = stage(asked.join(self._cached(spark).select("cache_key", F.lit(True).alias("hit")), "cache_key", "left"), "asked")
        new = asked.where("hit is null").drop("hit")
        total, misses = asked.count(), new.count()
        self.hits, self.misses = self.hits + total - misses, self.misses + misses
        if misses:
            found = self.inner.check(new, with_suggestions)
            rows = new.select("cache_key").join(found.select("cache_key", "suggestions"), "cache_key", "left")
            rows = rows.select("cache_key", F.col("suggestions").isNull().alias("is_known"), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"), F.current_timestamp().alias("stored_at"))
            rows.write.mode("append").parquet(self.path)
        unstage(asked)
        bad = self._cached(spark).where(~F.col("is_known")).select("cache_key", "suggestions")
        return keyed.join(bad, "cache_key").drop("cache_key")


@dataclass
class ChainSpeller:
    """For each language the first available speller that knows it; else the first available one, with a diagnostic."""

    spellers: list
    diagnostics: list[tuple[str, str]] = None  # type: ignore[assignment]
    name: str = "auto"

    def choose(self, language: str):
        ready = [s for s in self.spellers if s.is_available()]
        if not ready:
            raise SpellerNotAvailable("no speller is available")
        for s in ready:
            if s.supports(language):
                return s
        self.diagnostics = [*(self.diagnostics or []), ("backend_fallback", f"no speller knows {language}; {ready[0].name} is used")]
        return ready[0]

    def is_available(self) -> bool:
        return any(s.is_available() for s in self.spellers)

    def languages(self) -> list[str]:
        return sorted({x for s in self.spellers if s.is_available() for x in s.languages()})

    def supports(self, language: str) -> bool:
        return any(s.is_available() and s.supports(language) for s in self.spellers)

    def describe(self) -> str:
        return ", ".join(f"{s.name}: {'available' if s.is_available() else 'unavailable'}" for s in self.spellers)

    def check(self, words: DataFrame, with_suggestions: bool = True) -> DataFrame:
        spoken = sorted(r[0] for r in words.select("language").where("language is not null").distinct().collect())
        by: dict[int, tuple[object, list[str]]] = {}
        for x in spoken:
            s = self.choose(x)
            by.setdefault(id(s), (s, []))[1].append(x)
        out = None
        for s, some in by.values():
            part = s.check(words.where(F.col("language").isin(some)), with_suggestions)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else NullSpeller().check(words)


def read_answer(line: str) -> tuple[bool, list[str]] | None:
    """(known, suggestions) of an answer line of the ispell pipe protocol; None for other lines."""
    if not line:
        return None
    if line[0] in "*+-":
        return True, []
    if line[0] == "#":
        return False, []
    if line[0] in "&?":
        return False, [x.strip() for x in line.partition(":")[2].split(",") if x.strip()]
    return None


class Conversation:
    """A process that speaks the ispell pipe protocol; every wait for it ends after `timeout` seconds."""

    def __init__(self, command: list[str], timeout: float, terse: bool) -> None:
        self.timeout, self.buffer = timeout, b""
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self.banner = self._line()
        if terse:  # known words give no line
            self._say("!")

    def _say(self, line: str) -> None:
        self.process.stdin.write(f"{line}\n".encode())
        self.process.stdin.flush()

    def _line(self) -> str:
        until = time.monotonic() + self.timeout
        while b"\n" not in self.buffer:
            ready, _, _ = select.select([self.process.stdout], [], [], max(0.0, until - time.monotonic()))
            if not ready:
                raise SpellerProcessError(f"no answer within {self.timeout:g} s")
            data = os.read(self.process.stdout.fileno(), 1 << 16)
            if not data:
                raise SpellerProcessError("the speller process has ended")
            self.buffer += data
        line, _, self.buffer = self.buffer.partition(b"\n")
        return line.decode("utf-8", "replace").rstrip("\r")

    def ask(self, word: str) -> tuple[bool, list[str]]:
        """(known, suggestions): the first line that is an answer, up to the blank line that ends it."""
        self._say(f"^{word}")
        answer = None
        while line := self._line():
            answer = answer or read_answer(line)
        return answer or (True, [])

    def stop(self) -> None:
        self.process.kill()
        self.process.wait()


def _output(command: list[str], timeout: float) -> str:
    """What a command says on both streams, given no input; nothing if it can't be run in time."""
    try:
        done = subprocess.run(command, input=b"", capture_output=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return (done.stderr + b"\n" + done.stdout).decode("utf-8", "replace")


@dataclass
class PipeSpeller:
    """An ispell-compatible process per task and language, restarted once per task.

    {language} in the command is replaced, and {dictionaries} by the language
    and its own extra dictionaries. Languages are those given, or those that
    `list_command` names on this machine. terse: whether known words are
    answered by a blank line alone.
    """

    command: tuple[str, ...]
    known_languages: tuple[str, ...] | None = None
    dictionaries: dict[str, tuple[str, ...]] | None = None
    list_command: tuple[str, ...] = ()
    max_suggestions: int = MAX_SUGGESTIONS
    timeout: float = 10.0
    terse: bool = True
    name: str = "pipe"

    def is_available(self) -> bool:
        import shutil

        return shutil.which(self.command[0]) is not None

    def languages(self) -> list[str]:
        if self.known_languages is None:
            listed = _output(list(self.list_command), self.timeout) if self.list_command and self.is_available() else ""
            self.known_languages = tuple(language_names(listed))
        return list(self.known_languages)

    def supports(self, language: str) -> bool:
        return language.replace("-", "_") in self.languages()

    def describe(self) -> str:
        version = _output([self.command[0], "--version"], 5.0).strip().splitlines()
        return version[0] if version else f"{self.name}: {' '.join(self.command)}"

    def command_for(self, language: str) -> list[str]:
        every = ",".join([language, *(self.dictionaries or {}).get(language, ())])
        return [c.replace("{language}", language).replace("{dictionaries}", every) for c in self.command]

    def check(self, words: DataFrame, with_suggestions: bool = True) -> DataFrame:
        speller = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            open_: dict[str, Conversation] = {}
            restarts = 1
            try:
                for batch in batches:
                    rows = []
                    for language, word in zip(batch["language"], batch["word"]):
                        for attempt in (0, 1):
                            try:
                                if language not in open_:
                                    open_[language] = Conversation(speller.command_for(language.replace("-", "_")), speller.timeout, speller.terse)
                                known, found = open_[language].ask(word)
                                break
                            except (OSError, SpellerProcessError) as e:
                                if language in open_:
                                    open_.pop(language).stop()
                                if attempt or not restarts:
                                    raise SpellerProcessError(f"{speller.name}: {e}") from e
                                restarts -= 1
                        if not known:
                            rows.append((language, word, found[: speller.max_suggestions] if with_suggestions else []))
                    yield pd.DataFrame(rows, columns=["language", "word", "suggestions"])
            finally:
                for p in open_.values():
                    p.stop()

        asked = words.select("language", "word").distinct().repartition("language", "word")
        bad = asked.mapInPandas(run, "language string, word string, suggestions array<string>")
        return words.join(bad, ["language", "word"])


def language_names(listing: str) -> list[str]:
    """Names of languages among the lines of a listing; paths stand for their last part."""
    names = (line.strip().replace("\\", "/").rpartition("/")[2] for line in listing.splitlines() if ":" not in line)
    return list(dict.fromkeys(n for n in names if re.fullmatch(r"[a-z]{2,3}(_[A-Za-z]{2,4})?(-[\w-]+)?", n)))


def hunspell(languages: tuple[str, ...] | None = None, dictionaries: dict[str, tuple[str, ...]] | None = None) -> PipeSpeller:
    """dictionaries: extra ones of each language."""
    return PipeSpeller(("hunspell", "-a", "-i", "utf-8", "-d", "{dictionaries}"), languages, dictionaries, ("hunspell", "-D"), name="hunspell")


def aspell(languages: tuple[str, ...] | None = None) -> PipeSpeller:
    return PipeSpeller(("aspell", "-a", "--lang={language}", "--encoding=utf-8"), languages, None, ("aspell", "dicts"), name="aspell")
