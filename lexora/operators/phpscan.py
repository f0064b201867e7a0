"""Names, comments and strings of PHP source: a lexer with the little context that declarations need."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.operators import suppression
from lexora.schema import DEFAULT_KINDS

_TOKEN = re.compile(
    r"(?P<doc>/\*\*(?=\s).*?\*/)|(?P<block>/\*.*?\*/)|(?P<line>//[^\n]*?(?=\?>|\r?\n|\Z)|\#(?!\[)[^\n]*?(?=\?>|\r?\n|\Z))"
    r"|(?P<heredoc><<<[ \t]*(?P<quote>['\"]?)(?P<label>[A-Za-z_]\w*)(?P=quote)\r?\n(?:.*?\n)??[ \t]*(?P=label)\b)"
    r"|(?P<single>'(?:[^'\\]++|\\.)*+')|(?P<double>\"(?:[^\"\\]++|\\.)*+\")"
    r"|(?P<variable>\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)|(?P<name>\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*)"
    r"|(?P<number>\d[\w.]*)|(?P<close>\?>)|(?P<sign>::|->|\?->|=>|[^\s\w])|(?P<broken>['\"])",
    re.S,
)
_OPEN = re.compile(r"<\?(?:php\b|=)?", re.I)
_MODIFIERS = {"public", "protected", "private", "static", "readonly", "var", "final", "abstract"}
_PAIRS = {")": "(", "]": "[", "}": "{"}


class PhpSyntaxError(ValueError):
    pass


def _tokens(code: str) -> Iterator[tuple[str, str, int]]:
    at, line = 0, 1
    while (start := _OPEN.search(code, at)) is not None:
        line += code.count("\n", at, start.end())
        at = start.end()
        while at < len(code):
            m = _TOKEN.search(code, at)
            if m is None:
                return
            line += code.count("\n", at, m.start())
            kind = "heredoc" if m.lastgroup in ("label", "quote") or m["heredoc"] else m.lastgroup
            if kind == "broken" or (kind == "sign" and m[0] in "'\""):
                raise PhpSyntaxError(f"a string has no end on line {line}")
            if kind == "close":
                at = m.end()
                break
            yield kind, m[0], line
            line += m[0].count("\n")
            at = m.end()


def _unescaped(text: str) -> str:
    if text[0] == "'":
        return re.sub(r"\\([\\'])", r"\1", text[1:-1])
    plain = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "$": "$", "e": "\x1b", "f": "\f", "v": "\v"}
    return re.sub(r"\\([ntr\\\"$efv])", lambda m: plain[m[1]], text[1:-1])


def collect(code: str, kinds: tuple[str, ...] = DEFAULT_KINDS) -> list[tuple[str, str, int]]:
    """(kind, value, line) of declarations, comments and strings; unbalanced brackets and open strings are errors."""
    found: list[tuple[str, str, int]] = []
    tokens: list[tuple[str, str, int]] = []
    for kind, text, line in _tokens(code):
        if kind in ("doc", "block", "line"):
            found.append(("docblock" if kind == "doc" else "comment", text, line))
        else:
            tokens.append((kind, text, line))

    def add(kind: str, value: str, line: int) -> None:
        if value:
            found.append((kind, value, line))

    stack: list[tuple[str, str, int]] = []  # (bracket, what it is, line)
    pending = ""  # what the next brace or parenthesis belongs to
    head: set[str] = set()  # modifiers of the member that is being read
    word = lambda k: tokens[k][1].lower() if 0 <= k < len(tokens) and tokens[k][0] == "name" else ""
    sign = lambda k: tokens[k][1] if 0 <= k < len(tokens) else ""
    for k, (kind, text, line) in enumerate(tokens):
        inside = stack[-1][1] if stack else ""
        low = text.lower() if kind == "name" else ""
        called = sign(k - 1) in ("->", "?->", "::")
        if kind == "sign":
            if text in "([{":
                what = pending if (text == "(" and pending in ("parameters", "method parameters")) or (text == "{" and pending == "class") else "value" if text != "{" else "block"
                if text == "[" and sign(k - 1) == "#":
                    what = "attribute"
                stack.append((text, what, line))
                if what != "value" and pending:
                    pending = ""
                head = set()
            elif text in ")]}":
                if not stack or stack[-1][0] != _PAIRS[text]:
                    raise PhpSyntaxError(f'unexpected "{text}" on line {line}')
                stack.pop()
            elif text == ";":
                head = set()
                if pending != "class":
                    pending = ""
            elif text == "," and inside in ("parameters", "method parameters"):
                head = set()
        elif kind == "name" and not called:
            if low in ("class", "interface", "trait", "enum") and tokens[k + 1 : k + 2] and tokens[k + 1][0] == "name" and word(k + 1) not in ("extends", "implements") and sign(k - 1) not in ("::", "new"):
                add("class_like", tokens[k + 1][1], tokens[k + 1][2])
                pending = "class"
            elif low == "class" and sign(k - 1) != "::" and word(k - 1) in ("new", "readonly"):
                pending = "class"
            elif low == "namespace" and k + 1 < len(tokens) and tokens[k + 1][0] == "name":
                for part in tokens[k + 1][1].strip("\\").split("\\"):
                    add("namespace", part, line)
            elif low in ("function", "fn"):
                at = k + 2 if sign(k + 1) == "&" else k + 1
                pending = "parameters"
                if at < len(tokens) and tokens[at][0] == "name":
                    method = inside == "class"
                    add("method" if method else "function", tokens[at][1], tokens[at][2])
                    pending = "method parameters" if method else "parameters"
            elif low == "const":
                at, depth = k + 1, 0
                while at < len(tokens) and not (depth == 0 and tokens[at][1] == ";"):
                    depth += (tokens[at][1] in ("(", "[", "{")) - (tokens[at][1] in (")", "]", "}"))
                    if depth == 0 and tokens[at][0] == "name" and sign(at + 1) == "=" and (at == k + 1 or sign(at - 1) == "," or tokens[at - 1][0] == "name"):
                        add("constant", tokens[at][1], tokens[at][2])
                    at += 1
            elif low == "case" and inside == "class" and k + 1 < len(tokens) and tokens[k + 1][0] == "name" and sign(k + 2) in (";", "="):
                add("constant", tokens[k + 1][1], tokens[k + 1][2])
            if low in _MODIFIERS and inside in ("class", "method parameters", "parameters"):
                head.add(low)
        elif kind == "variable":
            name = text[1:]
            if inside in ("parameters", "method parameters") and sign(k - 1) not in ("=",):
                add("property" if head & {"public", "protected", "private", "readonly"} else "parameter", name, line)
            elif inside == "class" and head:
                add("property", name, line)
            add("variable", name, line)
        elif kind in ("single", "double"):
            if kind == "single" or not re.search(r"(?<!\\)(?:\$[A-Za-z_{]|\{\$)", text):
                add("string_literal", _unescaped(text), line)
        elif kind == "heredoc":
            body = text.split("\n", 1)[1].rsplit("\n", 1)
            if len(body) == 2 and ("'" in text.split("\n", 1)[0] or "$" not in body[0]):
                add("string_literal", body[0], line)
    if stack:
        raise PhpSyntaxError(f'"{stack[-1][0]}" on line {stack[-1][2]} has no end')
    return [f for f in found if f[0] in kinds]


SCHEMA = "path string, kind string, value string, line int, error string, suppressed long"


def decode(content: bytes) -> str | None:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        try:
            return content.decode("cp1252")
        except UnicodeDecodeError:
            return content.decode("latin-1") if b"\x00" not in content else None


def scan(files: DataFrame, kinds: tuple[str, ...] = DEFAULT_KINDS, prefix: str = suppression.PREFIX) -> DataFrame:
    """Rows of files(path, content): names, and an error row for a file that can't be read; a row with only `suppressed` counts the names on ignored lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                code = decode(bytes(content or b""))
                if code is None:
                    rows.append((path, None, None, None, "encoding: not a text", 0))
                    continue
                marks = suppression.scan(code, prefix)
                if marks.whole_file:
                    continue
                try:
                    names = collect(code, kinds)
                except PhpSyntaxError as e:
                    rows.append((path, None, None, None, f"parse_error: {e}", 0))
                    continue
                seen, hidden = set(), 0
                for kind, value, line in names:
                    if marks.ignores(line):
                        hidden += 1
                    elif kind not in ("docblock", "comment") or (line, value) not in seen:
                        seen.add((line, value))
                        rows.append((path, kind, value, line, None, 0))
                if hidden:
                    rows.append((path, None, None, None, None, hidden))
            yield pd.DataFrame(rows, columns=["path", "kind", "value", "line", "error", "suppressed"]).astype({"line": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def fragments(scanned: DataFrame, language: str = "en", project_dir: str = "") -> DataFrame:
    """Fragments of scanned names; each keeps its kind, identifier and path."""
    path = F.when(F.col("path").startswith(project_dir), F.ltrim(F.col("path").substr(F.lit(len(project_dir) + 1), F.length("path")), F.lit("/"))).otherwise(F.col("path")) if project_dir else F.col("path")
    mode = F.when(F.col("kind").isin("docblock", "comment"), "docblock").when(F.col("kind") == "string_literal", "prose").otherwise("identifier")
    identifier = F.when(F.col("kind").isin("docblock", "comment", "string_literal"), F.lit("")).otherwise(F.col("value"))
    return scanned.where("kind is not null").select(
        F.concat_ws(":", path, F.lpad(F.col("line").cast("string"), 8, "0"), "kind", F.sha2("value", 256)).alias("fragment_id"), F.col("value").alias("text"), F.col("value").alias("original_text"), F.lit(language).alias("language"),
        F.struct(F.lit("php").alias("source"), F.create_map(F.lit("kind"), F.col("kind"), F.lit("identifier"), identifier, F.lit("path"), path).alias("attributes")).alias("context"),
        F.struct(path.alias("path"), F.col("line").alias("line"), F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("logical")).alias("location"),
        F.lit(None).cast("array<struct<out:int,orig:int,len:int>>").alias("offsets"), mode.alias("mode"),
    )
