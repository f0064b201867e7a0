"""ICU message syntax: the text spans of a message, with exact origins. Recursive, so plain Python under a pandas UDF."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

from lexora.errors import IcuSyntaxError

BRANCHING = {"plural", "select", "selectordinal"}
QUOTABLE = "{}#|"
SCHEMA = "struct<spans:array<struct<text:string,start:int,segments:array<struct<out:int,orig:int,len:int>>>>,error:string>"


@dataclass
class Span:
    """Text with the origin of each of its characters."""

    text: str
    origins: list[int]

    @property
    def start(self) -> int:
        return self.origins[0]

    def segments(self) -> list[dict[str, int]]:
        out: list[dict[str, int]] = []
        for k, o in enumerate(self.origins):
            if out and out[-1]["orig"] + out[-1]["len"] == o:
                out[-1]["len"] += 1
            else:
                out.append({"out": k, "orig": o, "len": 1})
        return out


class _Reader:
    """Walks a message with an explicit stack of open branches, so that depth is bounded by memory alone."""

    def __init__(self, message: str):
        self.s, self.at, self.spans = message, 0, []
        self.held: list[tuple[str, int]] = []

    def fail(self, what: str) -> IcuSyntaxError:
        return IcuSyntaxError(f"{what} (at character {self.at})")

    def peek(self) -> str:
        return self.s[self.at] if self.at < len(self.s) else ""

    def blanks(self) -> None:
        while self.at < len(self.s) and self.s[self.at].isspace():
            self.at += 1

    def until(self, stops: str) -> str:
        start = self.at
        while self.at < len(self.s) and self.s[self.at] not in stops:
            self.at += 1
        return self.s[start : self.at]

    def close_span(self) -> None:
        if "".join(c for c, _ in self.held).strip(" \t\n\r\0\x0b"):
            self.spans.append(Span("".join(c for c, _ in self.held), [o for _, o in self.held]))
        self.held = []

    def quote(self) -> list[tuple[str, int]]:
        """After an apostrophe: a literal one, or a quoted section."""
        first = self.at
        self.at += 1
        if self.peek() == "'":
            self.at += 1
            return [("'", first)]
        if self.peek() == "" or self.peek() not in QUOTABLE:
            return [("'", first)]
        out = []
        while self.at < len(self.s):
            c = self.s[self.at]
            if c == "'":
                if self.s[self.at + 1 : self.at + 2] == "'":
                    out.append(("'", self.at))
                    self.at += 2
                    continue
                self.at += 1
                break
            out.append((c, self.at))
            self.at += 1
        return out

    def style(self) -> None:
        """Past a style that holds no text."""
        depth = 1
        while self.at < len(self.s):
            c = self.s[self.at]
            if c == "'":
                self.quote()
                continue
            depth += (c == "{") - (c == "}")
            self.at += 1
            if depth == 0:
                return
        raise self.fail("argument style has no end")

    def argument(self) -> str:
        """Past the head of an argument; its type if branches follow, else ''."""
        self.at += 1
        self.blanks()
        self.until(",}")
        for what in ("argument", "argument type"):
            self.blanks()
            if not self.peek():
                raise self.fail(f"{what} has no end")
            closing = self.peek() == "}"
            self.at += 1
            if closing:
                return ""
            if what == "argument":
                self.blanks()
                kind = self.until(",}").strip().lower()
        if kind in BRANCHING:
            return kind
        self.style()
        return ""

    def selector(self) -> bool:
        """Past the next selector and its brace; False at the end of the branches."""
        while True:
            self.blanks()
            if not self.peek():
                raise self.fail("branches have no end")
            if self.peek() == "}":
                self.at += 1
                return False
            name = self.until("{}").strip()
            offset = name.startswith("offset:")
            if offset and self.peek() and self.peek() != "{":
                continue
            if len(name.split()) != (2 if offset else 1) or self.peek() != "{":
                raise self.fail(f'expected "{{" after selector "{name}"')
            self.at += 1
            return True

    def read(self) -> list[Span]:
        branches: list[bool] = []  # open branches: whether # is a number there
        while self.at < len(self.s):
            c = self.s[self.at]
            if c == "'":
                self.held += self.quote()
            elif c == "{":
                self.close_span()
                kind = self.argument()
                if kind and self.selector():
                    branches.append(kind != "select")
            elif c == "}":
                if not branches:
                    raise self.fail('unexpected "}"')
                self.close_span()
                self.at += 1
                if not self.selector():
                    branches.pop()
            elif c == "#" and branches and branches[-1]:
                self.close_span()
                self.at += 1
            else:
                self.held.append((c, self.at))
                self.at += 1
        if branches:
            raise self.fail('argument has no end: missing "}"')
        self.close_span()
        return self.spans


def parse(message: str) -> list[Span]:
    return _Reader(message).read()


def _expand(texts: pd.Series) -> pd.DataFrame:
    spans, errors = [], []
    for text in texts:
        try:
            found = parse(text or "")
            spans.append([{"text": x.text, "start": x.start, "segments": x.segments()} for x in found])
            errors.append(None)
        except IcuSyntaxError as e:
            spans.append([])
            errors.append(str(e))
    return pd.DataFrame({"spans": spans, "error": errors})


def expand_udf(column: str):
    return F.pandas_udf(_expand, SCHEMA)(column)
