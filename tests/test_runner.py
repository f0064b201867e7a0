"""Messages from end to end, on in-memory fragments."""

import pytest
from pyspark.sql import functions as F

from lexora.errors import BaselineSchemaError
from lexora.operators import dictionary as D
from lexora.operators import findings as R
from lexora.operators import spellers
from lexora.plans.runner import Runner
from lexora.sources import fragments as S

ITALIAN = "ciao hai messaggi clicca inserisci indirizzo spedizione nessuno elementi mela mele".split()
ENGLISH = "order subscriber service".split()


def message(key, text, language="it", line=1):
    return (key, text, "", language, ("translation", {"locale": language, "domain": "messages", "key": key}), (f"messages.{language}.yaml", line, None, f"{language}/messages/{key}"), None, "prose")


def code(name, line=14):
    return (name, name, "", "en", ("php", {"kind": "class", "identifier": name, "path": "src/A.php"}), ("src/A.php", line, None, None), None, "identifier")


@pytest.fixture(scope="module")
def result(spark):
    rows = [
        message("hello", "Ciao %name%, hai %count% messagi", line=12),
        message("link", '<a href="/xxxx">Clicca qui</a>', line=20),
        message("ship", "Inserisci il tuo indirizio di spedizione", line=30),
        message("many", "{0} Nessuno|]0,1] Hai|]1,Inf] %count% elementi", line=40),
        message("icu", "{n, plural, one {Hai una mela} other {Hai # mele}}", line=50),
        message("bad", "{n, plural, one {Hai una mela", line=60),
        message("ja", "konnichiwa", "ja", 70),
        code("OrderSuscriber"),
    ]
    words = D.aggregate(D.from_words(spark, ITALIAN, "it"), D.from_words(spark, ENGLISH, "en"))
    out = Runner(spellers.WordListSpeller(words), available=["it", "en"], excluded=["ja"]).run(S.from_rows(spark, rows))
    return out, [r.asDict(recursive=True) for r in out.findings.collect()]


def test_findings_in_order_with_places_and_suggestions(result):
    rows = result[1]
    assert [r["word"] for r in sorted(rows, key=lambda r: r["location"]["path"])] == [r["word"] for r in rows]
    found = {r["word"]: r for r in rows}
    assert set(found) == {"messagi", "indirizio", "Suscriber"}
    assert found["messagi"]["location"]["column"] == 26 and found["messagi"]["location"]["line"] == 12
    assert found["messagi"]["suggestions"][0] == "messaggi"
    assert found["indirizio"]["suggestions"] == ["indirizzo"]
    assert found["Suscriber"]["suggestions"] == ["OrderSubscriber"] and found["Suscriber"]["location"]["column"] is None


def test_diagnostics(result):
    assert {r["code"] for r in result[0].diagnostics.collect()} == {"icu_syntax", "unsupported_language"}


def test_baseline_round_trip(result, spark, tmp_path):
    path = str(tmp_path / "base.json")
    R.save_baseline(R.record(result[0].findings), path)
    first = open(path).read()
    R.save_baseline(R.record(result[0].findings), path, now="later")
    assert open(path).read() == first
    back = R.load_baseline(spark, path)
    assert back.count() == 3
    assert R.baseline_filter(back).apply(result[0].findings).count() == 0
    assert R.outdated(back, result[0].findings.where("word = 'messagi'")).count() == 2
    assert R.pruned(back, result[0].findings.where("word = 'messagi'")).count() == 1


def test_baseline_errors(spark, tmp_path):
    assert R.load_baseline(spark, str(tmp_path / "none.json")).count() == 0
    for body in ("{", '{"schema": 9}', '{"schema": 1, "fingerprint_schema": "v0"}', '{"schema": 1, "entries": {"a": 1}}'):
        path = tmp_path / "bad.json"
        path.write_text(body)
        with pytest.raises(BaselineSchemaError):
            R.load_baseline(spark, str(path))


@pytest.mark.parametrize("args,code", [((0, []), 0), ((1, []), 1), ((0, ["fatal"]), 2), ((0, ["encoding"]), 3), ((0, ["encoding"], 0, False, True), 1), ((0, ["encoding"], 0, False, False, True), 0), ((0, [], 1, True), 1)])
def test_exit_codes(args, code):
    assert R.exit_code(*args) == code


def test_compounds_and_language_scope(spark):
    known = D.for_languages(D.from_words(spark, ["order", "service"], "en"), ["en", "it"])
    words = spark.createDataFrame([("en", "order-service"), ("en", "l'order"), ("it", "order"), ("en", "ORDER")], "language string, word string")
    assert {tuple(r) for r in spellers.unknown(words, known).select("language", "word").collect()} == {("en", "l'order"), ("it", "order")}


def test_locales():
    assert D.resolve_locale("en") == "en_EN"
    assert D.resolve_locale("en-GB", ["en_GB", "en_US"]) == "en_GB"
    assert D.resolve_locale("en", ["en_GB", "en_US"]) in ("en_GB", "en_US")
    assert D.resolve_locale("fr", ["en_GB"]) is None


def test_empty_fragments(spark):
    empty = S.from_rows(spark, [])
    out = Runner(spellers.WordListSpeller(D.from_words(spark, ["word"], "en"))).run(empty)
    assert out.findings.where(F.lit(True)).count() == 0
