"""Inline suppression markers of source files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = "@lexora"


@dataclass
class Suppression:
    whole_file: bool = False
    lines: set[int] = field(default_factory=set)
    words: list[str] = field(default_factory=list)

    def ignores(self, line: int) -> bool:
        return self.whole_file or line in self.lines


def scan(code: str, prefix: str = PREFIX) -> Suppression:
    """What the markers of one file say; for files that are scanned in Python anyway."""
    out = Suppression()
    if prefix not in code:
        return out
    marks = re.compile(rf"{re.escape(prefix)}-(ignore-file|disable|enable|ignore-next-line|ignore-line|words)\b(?:\s+([^*/\n\r]+))?")
    off = False
    for number, line in enumerate(re.split(r"\r\n|[\n\r\x0b\x0c\x85  ]", code), 1):
        said = {m[1]: m[2] for m in marks.finditer(line)}
        if "ignore-file" in said:
            return Suppression(True, set(), out.words)
        off = ("disable" in said or off) and "enable" not in said
        if off or {"disable", "enable", "ignore-line", "ignore-next-line"} & set(said):
            out.lines.add(number)
        if "ignore-next-line" in said:
            out.lines.add(number + 1)
        if said.get("words"):
            out.words += [w for w in re.split(r"[\s,]+", said["words"].strip()) if w]
    return out


def ignored_lines(files: DataFrame, prefix: str = PREFIX, path_col: str = "path", code_col: str = "code") -> DataFrame:
    """(path, line) that markers ignore, all lines of an ignored file among them; the same rules on DataFrames."""

    def has(mark: str) -> Column:
        return F.col("text").rlike(rf"\Q{prefix}-{mark}\E\b")

    lines = files.where(F.contains(code_col, F.lit(prefix))).select(F.col(path_col).alias("path"), F.posexplode(F.split(code_col, r"\r\n|[\n\r]")).alias("at", "text"))
    lines = lines.select("path", (F.col("at") + 1).alias("line"), has("ignore-file").alias("all"), has("disable").alias("stop"), has("enable").alias("go"), has("ignore-line").alias("this"), has("ignore-next-line").alias("next"))
    by_line = Window.partitionBy("path").orderBy("line")
    state = F.when(F.col("go"), F.lit(0)).when(F.col("stop"), F.lit(1))
    off = F.coalesce(F.last(state, ignorenulls=True).over(by_line), F.lit(0)) == 1
    whole = F.max("all").over(Window.partitionBy("path"))
    marked = lines.withColumns({"ignored": whole | off | F.col("stop") | F.col("go") | F.col("this") | F.col("next") | F.coalesce(F.lag("next").over(by_line), F.lit(False))})
    return marked.where("ignored").select("path", "line")
