"""Offsets, tokenizers and distances against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from lexora.functions import offsets as O
from lexora.functions import patterns as P
from lexora.functions import text as T
from lexora.operators import tokenizers

TEXTS = ["", "word", "a\nbb ccc\n\ndddd", "naïve café\tl'eau-de-vie " * 40, "x" * 5000, "\n" * 100, "ab cd " * 700 + "\nlast", None]


def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def test_spans_have_starts_lines_and_columns(spark):
    rows = {r["id"]: r["s"] for r in texts(spark).select("id", T.spans(F.col("text"), "[a-zé]+").alias("s")).collect()}
    for i, text in enumerate(TEXTS):
        if text is None:
            assert rows[i] is None
            continue
        wanted = [(m.start(), text.count("\n", 0, m.start()) + 1, m.start() - text.rfind("\n", 0, m.start()), m.group()) for m in re.finditer("[a-zé]+", text)]
        assert [(s["start"], s["line"], s["column"], s["text"]) for s in rows[i]] == wanted


def test_running_sums_and_maxima(spark):
    for n in (0, 1, 31, 32, 33, 1000, 3000):
        values = [(7 * i) % 11 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums, most = df.select(T.running(F.col("v")), T.running(F.col("v"), lambda a, b: F.greatest(a, b), -1)).first()
        assert sums == [sum(values[:i]) for i in range(n)]
        assert most == [max(values[:i], default=-1) for i in range(n)]


def blank(text, pattern):
    out, segments, at = "", [], 0
    for m in re.finditer(pattern, text):
        if m.start() > at:
            segments.append((len(out), at, m.start() - at))
        out += text[at : m.start()] + " "
        at = m.end()
    if at < len(text):
        segments.append((len(out), at, len(text) - at))
    return out + text[at:], segments


def test_two_steps_compose_to_original_places(spark):
    first, second = "<[^>]*>", "%[a-z]+%"
    lines = ["Ciao %name%, hai <b>x</b> messagi", "<i>%a%</i>", "%a%%b%<p>t</p>", "plain", "<x>" * 50 + "tail %z% end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, text string")
    one, segments = O.blanked(F.col("text"), first)
    df = df.withColumns({"one": one, "s1": segments})
    two, inner = O.blanked(F.col("one"), second)
    df = df.withColumns({"two": two, "s2": inner})
    for r in df.select("text", "two", O.compose(F.col("s1"), F.col("s2")).alias("s")).collect():
        text, two = r["text"], blank(blank(r["text"], first)[0], second)[0]
        assert r["two"] == two
        for s in r["s"] or []:
            assert two[s["out"] : s["out"] + s["len"]] == text[s["orig"] : s["orig"] + s["len"]]
        assert sum(s["len"] for s in r["s"] or []) == len(text) - sum(map(len, re.findall(first + "|" + second, text))) or r["s"] is None


def test_translate_inside_gaps_and_ends(spark):
    segments = F.array(*[F.struct(F.lit(a).alias("out"), F.lit(b).alias("orig"), F.lit(c).alias("len")) for a, b, c in ((2, 10, 3), (6, 20, 2))])
    wanted = {0: 10, 2: 10, 4: 12, 5: 13, 6: 20, 7: 21, 9: 22}
    got = spark.range(1).select(*[O.translate(segments, F.lit(k)).alias(str(k)) for k in wanted]).first().asDict()
    assert {int(k): v for k, v in got.items()} == wanted


@pytest.mark.parametrize(
    "name,parts",
    [("OrderSuscriber", "Order Suscriber"), ("HTTPServer2", "HTTP Server2"), ("snake_case_name", "snake case name"), ("getÉtatX", "get État X"), ("a1B2", "a1 B2"), ("URL", "URL")],
)
def test_identifiers_split(spark, name, parts):
    assert " ".join(spark.range(1).select(tokenizers.identifier_parts(F.lit(name))).first()[0]) == parts


def test_prose_survives_long_chains(spark):
    text = "-".join(["aé"] * 20000)
    assert spark.createDataFrame([(text,)], "t string").select(F.size(F.regexp_extract_all("t", F.lit(P.PROSE), F.lit(0)))).first()[0] == 1


def test_distance_counts_bytes(spark):
    assert spark.range(1).select(T.byte_levenshtein(F.lit("perche"), F.lit("perché"))).first()[0] == 2


def test_excerpts_equal_the_plain_window(spark):
    text = ("alpha beta\tgamma " * 60).strip()
    df = spark.createDataFrame([(text,)], "t string")
    fields = ("start", "line", "column", "text")
    for s in df.select(F.explode(T.excerpts(F.col("t"), T.spans(F.col("t"), "[a-z]+"), fields)).alias("s")).select("s.*").collect():
        begin = max(0, s["start"] - 32)
        inner = re.sub(r"\s+", " ", text[begin : begin + len(s["text"]) + 64]).strip()
        assert s["excerpt"] == ("..." if begin else "") + inner + ("..." if s["start"] + len(s["text"]) + 32 < len(text) else "")
