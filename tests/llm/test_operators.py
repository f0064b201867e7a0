"""The operators against brute force on small fixtures, with nulls, empty texts, copies and extra columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lexora.llm import decontaminate, html_text, packing, pii, simhash, sketches, substrings, token_store, toxicity, warc
from lexora.llm.queries import ORACLES, QUERIES
from lexora.llm.vocab import vocabulary_path
from tests.oracle import duck_rows, spark_rows

PASSAGE = "The committee noted that the river had been measured on every working day of that long and quiet summer without a break. "


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    out = [(0, None), (1, ""), (2, "x"), (3, "  \n\t "), (4, "ÀÉ naïve — 漢字 😀 " * 30)]
    for i in range(5, 45):
        text = prose(rng.randint(3, 150))
        out.append((i, text + " " + PASSAGE if i % 3 == 0 else PASSAGE + text if i % 7 == 0 else text))
    out += [(45 + k, out[10][1]) for k in range(4)]
    out += [(49, out[12][1] + " tail"), (50, prose(4000)), (51, "a" * 3000), (52, " ".join(["again"] * 500))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "kept", 1, "s") for i, t in rows], "doc_id long, text string, node string, key int, source string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def tokens_of(name, rows):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(vocabulary_path(name))
    return {i: [*encoder.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}


def test_token_store_round_trip(docs, rows, empty):
    path = vocabulary_path("byte_bpe_50k.json")
    wanted, start = {}, 0
    for i, ids in sorted(tokens_of("byte_bpe_50k.json", rows).items()):
        wanted[i] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.round_trip(docs, path).collect()}
    assert got == wanted
    assert token_store.round_trip(empty, path).count() == 0


def check_packing(found, wanted):
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        documents[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(documents) == set(wanted)
    for i, pieces in documents.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(wanted[i])
            assert p["ids_crc32"] == crc(wanted[i][at : at + p["length"]])
            at += p["length"]
        assert at == len(wanted[i])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_packing_holds_each_id_once(docs, rows, empty):
    path = vocabulary_path("word_bpe_49k.json")
    wanted = tokens_of("word_bpe_49k.json", rows)
    padding = check_packing(packing.pack(docs, path).collect(), wanted)
    assert padding <= 4096
    assert packing.pack(empty, path).count() == 0


def plain_fingerprint(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, rows, empty):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    wanted = {i: (f"{prints[i]:016x}", root(i)) for i in prints}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == wanted
    assert simhash.near_duplicates(empty).count() == 0


def test_drop_copies_keeps_one_of_each_group(docs, rows, empty):
    left = {r["doc_id"] for r in simhash.drop_copies(docs).collect()}
    copies = {i for i, t in rows if t == rows[10][1]}
    assert left & copies == {min(copies)}
    assert {50, 51, 52} <= left
    assert simhash.drop_copies(docs).columns == docs.columns


def shingle_sets(texts):
    out = {}
    for i, text in texts.items():
        parts = text.split()
        out[i] = {" ".join(parts[k : k + 5]) for k in range(len(parts) - 4)} or ({" ".join(parts)} if parts else set())
    return out


def left_by_brute_force(texts, bound=0.8):
    """The smallest id of each group of texts linked by similarity."""
    sets, parent = shingle_sets(texts), {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and (not sets[a] and not sets[b] or sets[a] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i for i in texts if root(i) == i}


def test_drop_copies_searches_large_buckets(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    boiler = [word() for _ in range(60)]
    texts = {}
    for i in range(0, 240, 2):  # pairs of copies in a crowd that shares two thirds of its shingles
        own = [word() for _ in range(24)]
        texts[i], texts[i + 1] = " ".join(boiler + own), " ".join(boiler + own[:-6] + [word() for _ in range(6)])
    base = [word() for _ in range(100)]
    for i in range(240, 360):  # variants of a template, near to some and far from others
        own = list(base)
        for at in rng.sample(range(100), 3):
            own[at] = word()
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.drop_copies(docs).collect()} == left_by_brute_force(texts)


def test_drop_copies_finds_all_pairs_at_the_bound(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    texts = {}
    for i in range(0, 200, 2):  # 4 of 5 shingles
        own = [word() for _ in range(9)]
        texts[i], texts[i + 1] = " ".join(own[:8]), " ".join(own)
    for i in range(200, 220, 2):  # 800 of 1000, and 799
        own = [word() for _ in range(1004)]
        texts[i], texts[i + 1] = " ".join(own), " ".join(own[: 804 - (i % 4) // 2])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    left = {r["doc_id"] for r in simhash.drop_copies(docs).collect()}
    assert left == left_by_brute_force(texts) and len(left) == 115


def test_the_simhash_stage_links_by_fingerprints_and_by_similarity(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts: dict = {}
    for i in range(0, 60, 3):  # i and i+1 by fingerprint alone, i+1 and i+2 by similarity alone
        phrase, tail = f"{prose(3)} ", prose(60)
        texts[i + 1], texts[i], texts[i + 2] = phrase * 200 + prose(60), phrase * 200 + tail, phrase * 2 + tail
    base = prose(200).split()
    for i in range(60, 100):
        own = list(base)
        own[rng.randrange(200)] = word()
        texts[i] = " ".join(own)
    texts |= {i: prose(30) for i in range(100, 120)} | {120: "", 121: " \n", 122: None}
    plain = {i: t or "" for i, t in texts.items()}
    prints, sets, parent = {i: plain_fingerprint(t) for i, t in plain.items()}, shingle_sets(plain), {i: i for i in plain}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in plain:
        for b in plain:
            close = (prints[a] ^ prints[b]).bit_count() <= 2
            if a < b and (close or not sets[a] and not sets[b] or len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    wanted = {i for i in plain if root(i) == i}
    assert wanted < left_by_brute_force(plain)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()} == wanted


def test_warc_equals_sql(spark, sf):
    assert spark_rows(QUERIES["op4_warc"](spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == duck_rows(ORACLES["op4_warc"], sf)


def test_warc_small_equal_and_missing_pages(spark):
    page = "<p>é</p>" * 30
    pages = spark.createDataFrame([(3, "u", page), (1, "u", page), (2, None, None), (4, "v", "short"), (5, "v", "short")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = len(page.encode())
    assert got == {1: (n, sha(page), "response", None), 3: (n, sha(page), "revisit", 1), 2: (0, sha(""), "response", None), 4: (5, sha("short"), "response", None), 5: (5, sha("short"), "response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark, empty):
    texts = [None, "", "mail a.b+c@d-e.co.uk, or x@y.z.", "é 10.0.0.255 and 256.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (555) 010-9999 now +12 3", "漢" * 2000 + " a@b.cd", "1" * 5000, "4111111111111111" * 3, "+" * 50]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        base = base_spans(text or "")
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (text or "")[:50]
        assert [found[i][f"n_{k}"] for k in KINDS] == [sum(b.startswith(k) for b in base) for k in KINDS]
        assert set(base) <= set(found[i]["spans"].split(","))
    assert pii.find(empty).count() == 0


def test_pii_cards_in_pairs_and_single_digits(spark):
    card = "4111111111111111"
    pairs, singles = " ".join(card[k : k + 2] for k in range(0, 16, 2)), "-".join(card)
    texts = [f"pay with {pairs} now", f"pay with {singles} now", "no 1 2 3 here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for i, text in enumerate(texts):
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
    assert [found[i]["n_card"] for i in range(3)] == [1, 1, 0]
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == ["pay with <card> now", "pay with <card> now", "no 1 2 3 here"]


def test_substrings_equal_brute_force(docs, rows, empty):
    seen, wanted = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            window = data[k : k + 100]
            if window in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(window)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        wanted[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == wanted
    assert substrings.remove_repeats(empty).count() == 0


def test_sketches(docs, rows, empty):
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    following = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    found = {r["doc_id"]: r for r in sketches.edited(docs).collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        half = len(text) // 2
        edit = text[: len(text) - half] + texts[following[i]][:half]
        assert found[i]["n_chars"] == len(text) and found[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
        for j in texts:
            if texts[j] == text:
                assert found[i]["fingerprint"] == found[j]["fingerprint"]
    assert sketches.edited(empty).count() == 0


def test_html(spark):
    article = "".join(f"<p>Paragraph {k} of the article tells, at some length, how the old harbour was rebuilt &amp; opened.</p>" for k in range(6))
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a> <a href='/x'>News</a></nav><article>{article}</article><script>var x = 1;</script><footer><a href='/'>Imprint</a></footer></body></html>"
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "w", "")], "page_id long, url string, html string")).collect()}
    assert "rebuilt & opened." in got[1]["text"] and "var x" not in got[1]["text"] and "Imprint" not in got[1]["text"] and "Home" not in got[1]["text"]
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0


def test_decontamination_finds_passages_and_new_values(spark):
    item = "James has 12 apples and buys 30 more apples at the market before he walks 5 miles home with his sister every single morning"
    other = item.replace("James", "Maria").replace("12", "47").replace("30", "81").replace("5", "9")
    docs = spark.createDataFrame([(1, "Some words before. " + item + " and after that nothing."), (2, "It says: " + other), (3, "Nothing of this kind is in here, only apples."), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "Short")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).select("doc_id", "item_id").collect()}
    assert found == {(1, 7), (2, 7)}
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_numeric_items(spark):
    item = "12 km 30 kg 47 mm 81 days 9 cups 15 miles 22 grams 64 hours 5 tons"
    docs = spark.createDataFrame([(1, "Before it. " + item + " and after."), (2, re.sub("[0-9]+", "7", item)), (3, "Only 12 km and 30 kg.")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = [(r["doc_id"], r["item_id"], r["matched_windows"], r["item_windows"], r["kind"]) for r in decontaminate.leaks(docs, bench).collect()]
    assert found == [(1, 7, 13, 13, "verbatim")]


def test_decontamination_keeps_windows_beside_an_inconsistent_slot(spark):
    prose = PASSAGE * 2
    item = f"They sold 3 apples to the baker. {prose}It all took them 3 days of work in town. {PASSAGE}"
    texts = [item.replace("3 days", "5 days"), item.replace("3 apples", "4 apples").replace("3 days", "5 days"), item, item.replace("3", "9"), "They sold 4 apples to the baker. It all took them 5 days of work in town."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert {0, 1, 2, 3} <= set(found)
    assert [found[i]["kind"] for i in range(4)] == ["reparameterised", "reparameterised", "verbatim", "reparameterised"]
    assert found[0]["matched_windows"] < found[2]["matched_windows"] == found[2]["item_windows"] == found[3]["matched_windows"]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op10_toxicity"](spark, sf)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = scored.collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    # few toxic documents are labelled at this size: clean ones stay, and most toxic ones are found
    assert sum(p and not y for p, y in judged) <= 0.03 * sum(not y for _, y in judged)
    assert sum(p and y for p, y in judged) > 0.5 * sum(y for _, y in judged)


def test_pipeline_pieces(spark, sf):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert found and {r["doc_id"] for r in found} <= ids
    by = defaultdict(int)
    for r in found:
        by[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(n == total for (_, total), n in by.items())
