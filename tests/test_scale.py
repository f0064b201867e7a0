"""What must not grow with the input: what is sent to the driver, what moves, what a worker holds."""

import random

import pytest
from pyspark.sql import functions as F

from lexora.functions import patterns, text
from lexora.operators import locators, nearest, prose, spellers
from lexora.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance,first,letters", [(1, "é", "abé"), (2, "a", "ab"), (2, "漢", "abß漢")])
def test_nearest_entries_in_small_slices_equal_all_pairs(spark, monkeypatch, distance, first, letters):
    monkeypatch.setattr(nearest, "TOGETHER", 40)
    monkeypatch.setattr(nearest, "LONGEST", 6)  # longer ones are compared one by one
    monkeypatch.setattr(nearest, "SLICE_KEYS", 400)
    monkeypatch.setattr(nearest, "SLICE_WORDS", 20)
    pick = random.Random(7)
    some = lambda n: list({first + "".join(pick.choice(letters) for _ in range(pick.randint(0, 9))) for _ in range(n)})
    words, entries = some(50), [(e, pick.randint(0, 2)) for e in some(60)]
    found = spellers.suggestions(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(entries, "word string, pos long"), distance)
    wanted = {}
    for w in words:
        near = sorted((levenshtein(w.encode(), e.encode()), len(e), p, e) for e, p in entries if abs(len(e) - len(w)) <= distance)
        if best := [e for n, _, _, e in near if n <= distance][:3]:
            wanted[w] = best
    assert {r["word"]: r["suggestions"] for r in found.collect()} == wanted


def test_neighbourhoods_are_not_sent_to_the_driver(spark):
    """they are fifty times their words, so that a small dictionary made a broadcast of hundreds of MB."""
    words = spark.createDataFrame([("abcdef",)], "word string")
    for distance in (2, 3):
        text = plan(spellers.suggestions(words, spark.createDataFrame([("abcdeg", 0)], "word string, pos long"), distance))
        sent = [part for part in text.split("BroadcastExchange")[1:] if "array_distinct" in part.split("Exchange hash")[0]]
        assert not sent


ODD = ["", "a", "Wort", "l’été d'Éloïse-Marie--x 'quoted' étude ́abc 漢字仮名 x-́y ab-cd-", "𝒜𝒷𝒸𝒹 ok\r\nzwei Zeilen\n\nendlich", "ΟΔΟΣ ΟΔΟΣΟ İstanbul straße", "word " * 300, "\n\nnach Umbruch\n", "abcd" + "̀" * 3 + "-efgh"]


def test_scanned_words_equal_the_pattern(spark):
    """the places of words are found for many texts at once, not by nested array expressions for each."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    native = docs.select("doc_id", F.posexplode(text.spans(F.col("text"), patterns.PROSE, 2)).alias("word_idx", "t")).select("doc_id", "word_idx", "t.start", "t.line", "t.column", "t.text")
    found = prose.words(docs, ["doc_id"], 2, excerpts=True)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found.select("doc_id", "word_idx", "offset", "line", "original_column", "word")) == rows(native)
    both = found.join(docs, "doc_id").select(text.window(F.col("window"), F.col("cut_before"), F.col("cut_after")), text.excerpt(F.col("text"), F.col("offset"), F.length("word")))
    assert all(a == b for a, b in both.collect())
    counts = native.groupBy("doc_id", F.lower("text").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(prose.counted(docs, ["doc_id"], 2)) == rows(counts)


def test_tokens_are_scanned_in_numpy(spark, sf):
    assert "zip_with" not in plan(catalogue.QUERIES["prose_tokens_with_offsets"](spark, sf))


@pytest.mark.parametrize("name", ["exit_code", "finding_excerpt"])
def test_tokens_stay_where_they_are(spark, sf, monkeypatch, name):
    """F4 to F20: of unknown words there are too many to be sent to the tokens; the accepted ones are, so that no token moves."""
    monkeypatch.setattr(spellers, "small", lambda df, rows=0: df)  # as with many unknown words
    text_ = plan(catalogue.QUERIES[name](spark, sf))
    assert "SortMergeJoin" not in text_ and "hashpartitioning(language" not in text_


def test_lacking_by_shuffle_and_by_buckets(spark, monkeypatch):
    words = spark.createDataFrame([("en", "Known", 1), ("en", "other", 2), ("de", "known", 3), (None, "known", 4), ("en", None, 5)], "language string, word string, n int")
    known = spark.createDataFrame([("en", "known"), ("en", "known"), (None, "other")], "language string, word string")
    for rows in (3_000_000, 0):
        monkeypatch.setattr(spellers, "LOOKUP_ROWS", rows)
        assert sorted(r["n"] for r in spellers.lacking(words, known).collect()) == [2, 3, 4, 5]


def test_a_document_in_several_rows_counts_once(spark, tmp_path):
    rows = [(1, "en", "alpha beta Alpha"), (1, "en", "alpha"), (2, "en", "alpha")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, catalogue.vocabulary(spark, str(tmp_path)).collect())) == [("en", "alpha", 4, 2), ("en", "beta", 1, 1)]



def test_names_of_files_come_in_parts(spark, monkeypatch):
    """the rows of all files of a task were held together."""
    monkeypatch.setattr(locators, "ROWS", 2)
    yaml = "a:\n  b: 'x'\r\n  c: y\nd:\n  b: x\u2028  e: z\na:\n  b: x2\n"
    files = [("l/m.en.yaml", yaml), ("l/m.de.yml", "k: v\n" * 3), ("l/m.en.php", "<?php\n 'k' => 'v',\n \"k\" => 'w',\n"), ("l/m.en.xlf", '<source>s &amp; t</source>\n<source>s &amp; t</source><target>u</target>'), ("l/m.en.txt", "k: v"), ("l/n.en.php", None), ("l/n.en.yaml", yaml)]
    found = locators.index(spark.createDataFrame(files, "path string, text string").coalesce(1))
    whole = {"yaml": locators.yaml_index, "yml": locators.yaml_index, "php": locators.php_index, "xlf": locators.xliff_index}
    wanted = sorted((p, *r) for p, t in files if (read := whole.get(p.rpartition(".")[2])) for r in read(t or ""))
    assert sorted(map(tuple, found.collect())) == wanted
