"""Grammars and backends against written cases and plain Python."""

import json
import os
import stat
import sys
import textwrap
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lexora.errors import IcuSyntaxError, SpellerProcessError
from lexora.functions import patterns as P
from lexora.operators import dictionary as D
from lexora.operators import docblock, icu, locators, phpscan, report, spellers
from lexora.operators import processors as PR
from lexora.plans.runner import Runner
from lexora.sources import fragments as S

ICU = [
    ("Hello world", ["Hello world"]), ("Ciao {name}", ["Ciao "]), ("a {x} b", ["a ", " b"]), ("{n, plural, one {Hai una mela} other {Hai # mele}}", ["Hai una mela", "Hai ", " mele"]),
    ("{g, select, female {Benvenuta} other {Benvenuto}}", ["Benvenuta", "Benvenuto"]), ("{n, selectordinal, one {#st place} other {#th place}}", ["st place", "th place"]), ("{n, plural, offset:1 one {uno} other {altri}}", ["uno", "altri"]),
    ("{n, plural, =0 {vuoto} other {pieno}}", ["vuoto", "pieno"]), ("{v, number, ::currency/EUR} totale", [" totale"]), ("{d, date, short} scadenza", [" scadenza"]), ("l''utente", ["l'utente"]), ("it's fine", ["it's fine"]),
    ("usa '{'placeholder'}'", ["usa {placeholder}"]), ("'#' hash", ["# hash"]), ("{a, plural, one {{b, select, x {rosso} other {blu}}} other {molti}}", ["rosso", "blu", "molti"]), ("issue #42 filed", ["issue #42 filed"]), ("{n, plural, one { } other {molti}}", ["molti"]),
]


@pytest.mark.parametrize("message,texts", ICU)
def test_icu_spans(message, texts):
    spans = icu.parse(message)
    assert [s.text for s in spans] == texts
    for s in spans:
        assert all(message[o] == c for c, o in zip(s.text, s.origins) if c != "'")


@pytest.mark.parametrize("message", ["{n, plural, one {x", "hello }", "{n, plural, one other {x}}", "{v, number, ::currency"])
def test_icu_errors(message):
    with pytest.raises(IcuSyntaxError):
        icu.parse(message)


def test_icu_hint(spark):
    rows = [("{n, plural, one {a} other {b}}", True), ("{v, number, integer}", True), ("Ciao {name}", False), ("Ciao", False)]
    got = spark.createDataFrame(rows, "m string, wanted boolean").select(F.col("m").rlike(P.ICU_HINT).alias("got"), "wanted").collect()
    assert all(r["got"] == r["wanted"] for r in got)


DOCS = [
    ("/**\n * Says {@see X} a thing.\n * @param int|null $foo the {@link Y} value\n * @ORM\\Column\n * @return string\n */", "\nSays   a thing.\nthe   value\n\nstring\n\n"),
    ("// one\r\n# two\n  * three */", "one\ntwo\nthree \n"), ("@param {@see X} $foo desc", "desc\n"), ("no mark", "no mark\n"), ("", "\n"), ("a\rb\x0bc d", "a\rb\x0bc d\n"), (" * @todo later", "later\n"), ("* @Note x $y", "\n"),
]


@pytest.mark.parametrize("text,wanted", DOCS)
def test_docblock_lines_and_segments(text, wanted):
    shown, segments = docblock.clean(text)
    assert shown == wanted
    for s in segments:
        assert shown[s["out"] : s["out"] + s["len"]] == text[s["orig"] : s["orig"] + s["len"]]
    kept = {k for s in segments for k in range(s["out"], s["out"] + s["len"])}
    assert all(shown[k] in " \n" for k in range(len(shown)) if k not in kept)


def test_legacy_plural_keeps_words_in_other_brackets(spark):
    rows = [("a", "{name} ha vintto|[beta] Nuvo elemento"), ("b", "{0} Nessuno|]0,1] Uno|]1,Inf] %count% elementi"), ("c", "no pipe"), ("d", "one||two"), ("e", "{1,2} a|"), ("f", "{0}|{1}")]
    fragments = S.from_rows(spark, [(k, t, "", "it", ("translation", {}), None, None, "prose") for k, t in rows])
    got: dict = {}
    for r in PR.legacy_plural().apply(fragments).collect():
        got.setdefault(r["fragment_id"], []).append(r["text"])
    assert got == {"a": ["{name} ha vintto", "[beta] Nuvo elemento"], "b": ["Nessuno", "Uno", "%count% elementi"], "c": ["no pipe"], "d": ["one||two"], "e": ["a"]}


def test_catalogue_files():
    yaml = "# c\na:\n  b: one\n  c: 'two'\n'd.e': \"x: y\"\nf:\n  b: one\n\"q: r\": s\n"
    assert set(locators.yaml_index(yaml)) == {("key", "a.b", 3), ("key", "a.c", 4), ("key", "d.e", 5), ("key", "f.b", 7), ("leaf", "c", 4), ("leaf", "d.e", 5), ("value", "one", 3), ("value", "two", 4), ("value", "x: y", 5)}
    xliff = '<file>\n<trans-unit id="1" resname="k.a"><source>A &amp; B</source>\n<target>T</target></trans-unit>\n<unit name="x" id="2">\n<source>A &amp; B</source>\n'
    assert set(locators.xliff_index(xliff)) == {("key", "1", 2), ("key", "k.a", 2), ("key", "A & B", 2), ("value", "T", 3), ("key", "2", 4)}
    php = "<?php\nreturn [\n'a\\'b' => 'x',\n\"t\\tu\" => 'y', 'z' => 1,\n'p' . 'q' => 2,\n'no'\n];"
    assert locators.php_index(php) == [("key", "a'b", 3), ("key", "t\tu", 4), ("key", "q", 5)]


def test_php_scan_of_a_file(spark):
    code = "<?php\n/** Doc. */\nclass Foo extends Bar {\n  // @lexora-ignore-next-line\n  const HIDEN = 1;\n  public function __construct(private int $promo, $plain) {}\n  // a note\n}\n"
    rows = phpscan.scan(spark.createDataFrame([("a.php", bytearray(code.encode())), ("b.php", bytearray(b"<?php class A { function ("))], "path string, content binary")).collect()
    names = {(r["kind"], r["value"], r["line"]) for r in rows if r["kind"]}
    assert {("docblock", "/** Doc. */", 2), ("class_like", "Foo", 3), ("property", "promo", 6), ("parameter", "plain", 6), ("comment", "// a note", 7)} <= names
    assert not any(v == "HIDEN" for _, v, _ in names)
    assert [r["error"].split(":")[0] for r in rows if r["error"]] == ["parse_error"]
    assert sum(r["suppressed"] for r in rows) == 2


FAKE = """
import sys, time
mode = sys.argv[1]
answers = {"mispell": "& mispell 2 0: misspell, misspelt", "nosuggestion": "# nosuggestion 0"}
if mode == "silent":
    time.sleep(60)
print("@(#) International Ispell (a fake)", flush=True)
terse = False
for n, line in enumerate(sys.stdin):
    line = line.rstrip("\\n")
    if line == "!":
        terse = True
        continue
    if mode == "dies" or (mode == "dies-once" and not __import__("os").path.exists(sys.argv[2])):
        open(sys.argv[2], "w").close()
        sys.exit(9)
    word = line.lstrip("^")
    if word in answers:
        print(answers[word])
    elif not terse:
        print("*")
    print(flush=True)
"""


@pytest.fixture
def fake(tmp_path):
    path = tmp_path / "fake.py"
    path.write_text(textwrap.dedent(FAKE))
    return lambda mode, **options: spellers.PipeSpeller((sys.executable, str(path), mode, str(tmp_path / "died")), ("en",), **options)


def words_of(spark):
    return spark.createDataFrame([("en", w) for w in ("mispell", "right", "nosuggestion", "mispell")], "language string, word string").coalesce(1)


@pytest.mark.parametrize("mode,terse", [("good", True), ("good", False), ("dies-once", True)])
def test_pipe_answers(spark, fake, mode, terse):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sorted((r["word"], r["suggestions"]) for r in fake(mode, terse=terse).check(words_of(spark)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == [("mispell", ["misspell", "misspelt"])] * 2 + [("nosuggestion", [])]


@pytest.mark.parametrize("mode,what", [("silent", "no answer within"), ("dies", "has ended")])
def test_pipe_failures_end(spark, fake, mode, what):
    talk = None
    with pytest.raises(SpellerProcessError, match=what):
        talk = spellers.Conversation(fake(mode).command_for("en"), 0.5, True)
        talk.ask("right")
    assert talk is None or talk.process.poll() is not None or talk.stop() is None


def test_backend_listings_and_commands(tmp_path):
    assert spellers.language_names("SEARCH PATH:\n.::/usr/share\nAVAILABLE DICTIONARIES:\n/usr/share/hunspell/en_US\n/usr/share/hunspell/it\nhyph_en\n") == ["en_US", "it"]
    assert spellers.hunspell(("en_US", "it"), {"it": ("extra",)}).command_for("it")[-1] == "it,extra"
    assert spellers.hunspell(("en_US", "it"), {"it": ("extra",)}).command_for("en_US")[-1] == "en_US"
    lister = tmp_path / "lister"
    lister.write_text("#!/bin/sh\necho en_GB; echo de >&2\n")
    os.chmod(lister, os.stat(lister).st_mode | stat.S_IXUSR)
    s = spellers.PipeSpeller((str(lister),), list_command=(str(lister), "-D"))
    assert sorted(s.languages()) == ["de", "en_GB"] and s.supports("en-GB") and not s.supports("fr")
    assert spellers.PipeSpeller(("no such binary",), list_command=("no such binary",)).languages() == []


def test_cache_counts_and_time_to_live(spark, tmp_path):
    words = spark.createDataFrame([("en", "order"), ("en", "ordre"), ("en", "Ordre")], "language string, word string")
    inner = spellers.WordListSpeller(D.from_words(spark, ["order"], "en"), only=("en",))
    cached = spellers.CachingSpeller(inner, str(tmp_path / "cache"))
    for _ in range(2):
        assert sorted((r["word"], r["suggestions"]) for r in cached.check(words).collect()) == [("Ordre", ["order"]), ("ordre", ["order"])]
    assert (cached.hits, cached.misses) == (2, 2)
    assert cached.is_available() and cached.supports("en") and cached.languages() == ["en"] and cached.describe().endswith("(cached)")
    old = spellers.CachingSpeller(inner, str(tmp_path / "cache"), ttl=3600)
    old.check(words).collect()
    assert (old.hits, old.misses) == (2, 0)
    spark.read.parquet(str(tmp_path / "cache")).withColumn("stored_at", F.expr("current_timestamp() - interval 2 hours")).write.parquet(str(tmp_path / "aged"))
    aged = spellers.CachingSpeller(inner, str(tmp_path / "aged"), ttl=3600)
    assert aged.check(words).count() == 2
    assert (aged.hits, aged.misses) == (0, 2)
    chain = spellers.ChainSpeller([cached])
    assert chain.check(words).count() == 2 and chain.describe() == "wordlist: available"
    assert spellers.WordListSpeller(inner.dictionary).supports("xx") and not inner.supports("xx")


def test_run_counts_cache_and_suppressed_names(spark, tmp_path):
    code = "<?php\nclass OrderSuscriber {\n  // @lexora-ignore-next-line\n  public function hiddn() {}\n}\n"
    scanned = phpscan.scan(spark.createDataFrame([("src/A.php", bytearray(code.encode())), ("src/B.php", bytearray(b"<?php ("))], "path string, content binary"))
    speller = spellers.CachingSpeller(spellers.WordListSpeller(D.from_words(spark, ["order", "subscriber", "lexora", "ignore", "next", "line"], "en")), str(tmp_path / "cache"))
    bad = scanned.where("error is not null").select(F.lit("parse_error").alias("code"), F.col("error").alias("message"), F.struct("path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("logical")).alias("location"))
    done = Runner(speller, available=["en"]).run(phpscan.fragments(scanned), bad, suppressed_inline=scanned.agg(F.sum("suppressed")).first()[0])
    assert [r["word"] for r in done.findings.collect()] == ["Suscriber"]
    assert [r["code"] for r in done.diagnostics.collect()] == ["parse_error"]
    counts = done.statistics.first()
    assert counts["suppressed_inline"] == 2 and counts["cache_misses"] == counts["unique_words_checked"] and counts["cache_hits"] == 0


def test_php_source_finds_files(spark, tmp_path):
    for name, code in {"a.php": "<?php class Alpha {}", "sub/tests/b.php": "<?php class Beta {}", "sub/c.php": "<?php class Gamma {", "d.txt": "<?php class Delta {}", "big.php": "<?php class Big {} //" + "x" * 3000, "latin.php": "<?php // caf\xe9\nclass Latin {}"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(code.encode("latin-1"))
    source = S.PhpSource((str(tmp_path), str(tmp_path / "d.txt"), str(tmp_path / "none")), exclude=("tests/",), max_size="2K", project_dir=str(tmp_path))
    rows = source.fragments(spark).collect()
    assert {(r["text"], r["location"]["path"]) for r in rows if r["context"]["attributes"]["kind"] == "class_like"} == {("Alpha", "a.php"), ("Latin", "latin.php"), ("Delta", "d.txt")}
    assert any(r["text"] == "// café" for r in rows)
    assert sorted((r["code"], r["location"]["path"].rpartition("/")[2]) for r in source.diagnostics(spark).collect()) == [("parse_error", "c.php"), ("skipped_file", "none")]
    assert source.suppressed(spark) == 0
    only = S.PhpSource((str(tmp_path),), exclude=("#^sub/|big#", "latin")).with_paths(str(tmp_path / "sub"), str(tmp_path))
    assert {r["text"] for r in only.fragments(spark).collect()} >= {"Alpha", "Beta"}


def test_reports_through_writers(spark, tmp_path):
    def row(word, source, path, line, suggestions=()):
        return (word, "spelling", list(suggestions), "en", (source, {"kind": "class", "identifier": word + "Name"} if source == "php" else {"locale": "en", "domain": "d", "key": "k"}), (path, line, None, f"en/d/{word}"), 'a "q" & <b>', "error", "f" * 16, "seed", "1", 0)

    schema = "word string, type string, suggestions array<string>, language string, context struct<source:string,attributes:map<string,string>>, location struct<path:string,line:int,column:int,logical:string>, excerpt string, severity string, fingerprint string, seed string, fragment_id string, word_idx int"
    rows = spark.createDataFrame([row("Ordr", "php", "src/A.php", 3, ["Order"]), row("messagi", "translation", "lang/m.yaml", 9, ["messaggi", "messaggio"]), row("Srvice", "php", "src/A.php", 1)], schema)
    texts = {name: report.render(name, rows, diagnostics=[{"message": "odd"}], outdated=["x"]) for name in report.REPORTERS}
    whole = json.loads(texts["json"])
    assert whole["summary"] == {"new": 3} and [i["word"] for i in whole["issues"]] == ["messagi", "Srvice", "Ordr"] and whole["diagnostics"] == [{"message": "odd"}] and whole["outdated_baseline_entries"] == ["x"]
    assert [i["location"]["lines"]["begin"] for i in json.loads(texts["gitlab"])] == [9, 1, 3]
    for name in ("checkstyle", "junit"):
        root = ElementTree.fromstring(texts[name].encode())
        assert len(list(root.iter("error" if name == "checkstyle" else "failure"))) == 3
    assert [f.get("name") for f in ElementTree.fromstring(texts["checkstyle"].encode())] == ["lang/m.yaml", "src/A.php"]
    assert texts["github"].splitlines()[0] == '::error file=lang/m.yaml,line=9,title=Spelling::Unknown word "messagi" - did you mean messaggi, messaggio? [en/d]'
    assert texts["csv"].splitlines()[1] == '"en","d","k","a ""q"" & <b>","messagi","messaggi, messaggio","lang/m.yaml","9"'
    lines = texts["table"].splitlines()
    assert lines.index("Translations") < lines.index("Code") and lines.count("  src/A.php") == 1 and "  3 new findings." in lines and "  ! 1 baseline entries were not found again; prune them." in lines
    none = rows.limit(0)
    assert json.loads(report.render("json", none))["issues"] == [] and json.loads(report.render("gitlab", none)) == [] and "No new findings" in report.render("table", none) and 'tests="1"' in report.render("junit", none)
    writer = report.BufferedWriter(decorated=True)
    report.write_report(writer, "table", rows)
    assert "\x1b[1mCode\x1b[0m" in writer.text
    with open(tmp_path / "r.csv", "w") as f:
        report.write_report(report.StreamWriter(f), "csv", rows)
    assert open(tmp_path / "r.csv").read() == texts["csv"]
    report.save_lines("csv", rows, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 3
    with pytest.raises(ValueError, match="unknown report"):
        report.render("no", rows)
