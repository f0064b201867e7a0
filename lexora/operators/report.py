"""Reports: a DataFrame of lines per format, in order, and writers for whole reports."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import groupby
from textwrap import indent
from typing import IO, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.functions import text as T
from lexora.operators.findings import ordered

RULE = "lexora.spelling"


def _attribute(name: str) -> Column:
    return F.element_at("context.attributes", name)


def _file(default: str) -> Column:
    return F.coalesce("location.path", "location.logical", F.lit(default))


def _listed() -> Column:
    return F.array_join("suggestions", ", ")


def _has() -> Column:
    return F.size("suggestions") > 0


def xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _json(c: Column) -> Column:
    """A JSON string of a text."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def github(findings: DataFrame) -> DataFrame:
    value = lambda c: F.replace(F.replace(F.replace(c, F.lit(","), F.lit("%2C")), F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), value(c.cast("string"))))
    where = F.concat_ws(",", part("file", F.col("location.path")), part("line", F.col("location.line")), part("col", F.col("location.column")), F.lit("title=Spelling"))
    message = F.concat(
        F.lit('Unknown word "'), F.col("word"), F.lit('"'), F.when(_has(), F.concat(F.lit(" - did you mean "), _listed(), F.lit("?"))).otherwise(""),
        F.coalesce(F.concat(F.lit(" ["), F.coalesce(_attribute("locale"), F.lit("?")), F.lit("/"), _attribute("domain"), F.lit("]")), F.lit("")),
        F.when(_attribute("identifier").isNotNull() & (_attribute("identifier") != F.col("word")), F.concat(F.lit(" ["), _attribute("identifier"), F.lit("]"))).otherwise(""),
    )
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        message = F.replace(message, F.lit(a), F.lit(b))
    return ordered(findings).select(F.concat(F.lit("::"), F.col("severity"), F.lit(" "), where, F.lit("::"), message).alias("value"))


CSV_HEADER = ("locale", "domain", "key", "message", "word", "suggestions", "file", "line")


def csv(findings: DataFrame) -> DataFrame:
    none = F.lit("")
    cells = [F.coalesce(_attribute("locale"), F.col("language"), none), F.coalesce(_attribute("domain"), _attribute("kind"), none), F.coalesce(_attribute("key"), _attribute("identifier"), none), F.col("excerpt"), F.col("word"), _listed(), F.coalesce("location.path", none), F.coalesce(F.col("location.line").cast("string"), none)]
    quoted = [F.concat(F.lit('"'), F.replace(F.regexp_replace(c, r"\r\n|\n|\r", " "), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]
    return ordered(findings).select(F.concat_ws(",", *quoted).alias("value"))


def gitlab(findings: DataFrame) -> DataFrame:
    """One JSON object per finding."""
    description = F.concat(F.lit('Unknown word "'), F.col("word"), F.lit('"'), F.when(_has(), F.concat(F.lit(" - did you mean "), _listed(), F.lit("?"))).otherwise(""))
    place = F.struct(_file("unknown").alias("path"), F.struct(F.coalesce("location.line", F.lit(1)).alias("begin")).alias("lines"))
    entry = F.struct(description.alias("description"), F.lit("spelling").alias("check_name"), "fingerprint", F.lit("minor").alias("severity"), place.alias("location"))
    return ordered(findings).select(F.to_json(entry).alias("value"))


def checkstyle(findings: DataFrame) -> DataFrame:
    """(file, value): the error lines of each file."""
    message = F.concat(F.lit('Unknown word "'), F.col("word"), F.lit('"'), F.when(_has(), F.concat(F.lit(" ("), _listed(), F.lit(")"))).otherwise(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    line = F.concat(F.lit('<error line="'), number("location.line"), F.lit('" column="'), number("location.column"), F.lit('" severity="'), F.col("severity"), F.lit('" message="'), xml(message), F.lit(f'" source="{RULE}"/>'))
    return ordered(findings).select(_file("unknown").alias("file"), line.alias("value"))


def junit(findings: DataFrame) -> DataFrame:
    """One failing test case per finding."""
    detail = F.concat(T.location_text(F.col("location")), F.lit("\nSuggestions: "), F.when(_has(), _listed()).otherwise("(none)"), F.lit("\nExcerpt: "), F.col("excerpt"))
    case = F.concat(F.lit('<testcase name="'), xml(F.col("word")), F.lit('" classname="'), xml(_file("spelling")), F.lit('"><failure type="spelling" message="'), xml(F.concat(F.lit('Unknown word "'), F.col("word"), F.lit('"'))), F.lit('">'), xml(detail), F.lit("</failure></testcase>"))
    return ordered(findings).select(case.alias("value"))


def json_rows(findings: DataFrame) -> DataFrame:
    entry = F.struct("word", "type", "suggestions", "language", "context", "location", "excerpt", "severity", "fingerprint")
    return ordered(findings).select(F.to_json(entry).alias("value"))


def table(findings: DataFrame) -> DataFrame:
    """(group, file, value): lines of the plain report."""
    group = F.when(F.col("context.source") == "translation", "Translations").otherwise("Code")
    at = F.when(F.col("location.line").isNull(), "(line unknown)").otherwise(F.concat(F.col("location.line").cast("string"), F.lit(":"), F.coalesce("location.column", F.lit(0)).cast("string")))
    kind, name = F.coalesce(_attribute("kind"), F.lit("")), F.coalesce(_attribute("identifier"), F.lit(""))
    label = F.when(F.col("context.source") == "translation", F.coalesce("location.logical", F.lit(""))).when(kind.isin("docblock", "comment", ""), kind).otherwise(F.trim(F.concat(kind, F.lit(" "), F.substring(name, 1, 40))))
    pad = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    line = F.concat(F.lit("    "), pad(at, 14), F.lit("  "), pad(F.col("word"), 24), F.lit("  "), F.when(_has(), F.concat(F.lit("-> "), _listed())).otherwise("(no suggestion)"), F.lit("  "), label)
    return ordered(findings).select(group.alias("group"), _file("(unknown location)").alias("file"), line.alias("value"))


class Writer(Protocol):
    """Where a report goes, piece by piece; decorated: whether it shows colours."""

    decorated: bool

    def write(self, text: str) -> None: ...


@dataclass
class BufferedWriter:
    """Keeps what is written, for tests and callers that want a text."""

    decorated: bool = False
    parts: list[str] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def reset(self) -> None:
        self.parts.clear()


@dataclass
class StreamWriter:
    """Writes to an open file."""

    stream: IO[str]
    decorated: bool = False

    def write(self, text: str) -> None:
        self.stream.write(text)


def _by_file(rows: DataFrame) -> Iterable[tuple[str, Iterable]]:
    """Rows file by file, in order; a file's rows follow each other, as findings are ordered by path."""
    return groupby(rows.toLocalIterator(), lambda r: r["file"])


def _colour(writer: Writer, code: int, text: str) -> str:
    return f"\x1b[{code}m{text}\x1b[0m" if writer.decorated else text


def write_report(writer: Writer, name: str, findings: DataFrame, statistics: dict | None = None, diagnostics: list[dict] | None = None, outdated: list[str] | None = None, seconds: float = 0.0) -> None:
    """A whole report, a row at a time. Findings without a path come last, and make an entry of a file for each run of equal names."""
    statistics, diagnostics, outdated = statistics or {}, diagnostics or [], outdated or []
    if name not in REPORTERS:
        raise ValueError(f"unknown report {name!r}; there are {', '.join(sorted(REPORTERS))}")
    rows = REPORTERS[name](findings)
    line = lambda text="": writer.write(f"{text}\n")
    if name in ("github", "csv"):
        if name == "csv":
            line(",".join(f'"{h}"' for h in CSV_HEADER))
        for r in rows.toLocalIterator():
            line(r["value"])
        for d in diagnostics if name == "github" else ():
            line(f"::warning title=Spelling::{d['message']}")
    elif name in ("gitlab", "json"):
        depth = 4 if name == "gitlab" else 8
        if name == "json":
            head = {"summary": {"new": rows.count(), **statistics}}
            writer.write(json.dumps(head, ensure_ascii=False, indent=4)[:-2] + ',\n    "issues": ')
        mark = "["
        for r in rows.toLocalIterator():
            writer.write(f"{mark}\n" + indent(json.dumps(json.loads(r["value"]), ensure_ascii=False, indent=4), " " * depth))
            mark = ","
        writer.write("[]" if mark == "[" else "\n" + " " * (depth - 4) + "]")
        if name == "json":
            tail = {"diagnostics": diagnostics, "outdated_baseline_entries": outdated}
            writer.write(",\n" + json.dumps(tail, ensure_ascii=False, indent=4)[2:])
        line()
    elif name == "checkstyle":
        line('<?xml version="1.0" encoding="UTF-8"?>')
        line('<checkstyle version="1.0">')
        for file, some in _by_file(rows):
            line(f'  <file name="{html.escape(file)}">')
            for r in some:
                line(f"    {r['value']}")
            line("  </file>")
        line("</checkstyle>")
    elif name == "junit":
        n = rows.count()
        line('<?xml version="1.0" encoding="UTF-8"?>')
        line(f'<testsuites name="spelling" tests="{max(1, n)}" failures="{n}" time="{seconds:.3f}">')
        line('  <testsuite name="spelling">')
        for r in rows.toLocalIterator():
            line(f"    {r['value']}")
        if not n:
            line('    <testcase name="spelling" classname="spelling"/>')
        line("  </testsuite>")
        line("</testsuites>")
    else:
        n, first = 0, rows.first()
        groups = ("Translations", "Code") if first and first["group"] == "Translations" else ("Code", "Translations")
        for group in groups if first else ():
            head = ["", _colour(writer, 1, group), "-" * 76]
            for file, some in _by_file(rows.where(F.col("group") == group)):
                for text in [*head, "", _colour(writer, 36, f"  {file}")]:
                    line(text)
                head = []
                for r in some:
                    line(r["value"])
                    n += 1
        line()
        line("-" * 76)
        line("  No new findings." if not n else _colour(writer, 31, f"  {n} new finding{'s' if n > 1 else ''}."))
        for d in diagnostics:
            line(f"  ! {d['message']}")
        if outdated:
            line(f"  ! {len(outdated)} baseline entries were not found again; prune them.")


def render(name: str, findings: DataFrame, **more) -> str:
    """A whole report as text."""
    writer = BufferedWriter()
    write_report(writer, name, findings, **more)
    return writer.text


def save_lines(name: str, findings: DataFrame, path: str) -> None:
    """The lines of a report as text files in order, written by the executors; for reports too large for one file."""
    REPORTERS[name](findings).select("value").write.text(path)


REPORTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"table": table, "json": json_rows, "github": github, "checkstyle": checkstyle, "junit": junit, "gitlab": gitlab, "csv": csv}
