"""The whole run against plain Python, and the order of findings."""

import hashlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import regex

from lexora.plans import catalogue

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*")
S = r"\p{Z}\t\n\x0B\f\r"
W = r"\p{L}\p{N}_"
STEPS = [
    rf"%[a-zA-Z0-9_.]+%|%%|\{{\{{[^{{}}]*\}}\}}|\{{[a-zA-Z0-9_.]*\}}|(?<![:{W}]):[a-zA-Z_][{W}]*",
    r"%(?:\p{Nd}+\$)?[-+ 0#]?(?:\p{Nd}+|\*)?(?:\.\p{Nd}+)?[bcdeEfFgGosuxX]",
    r"(?s)<!--.*?-->|</?[a-zA-Z][^<>]*>|&[a-zA-Z][a-zA-Z0-9]*;|&#x?[0-9a-fA-F]+;",
    rf"(?i)[a-z][a-z0-9+.\-]*://[^{S}]+|(?:mailto:)?[{W}.+\-]+@[{W}\-]+(?:\.[{W}\-]+)+|(?:^|[{S}])/(?:[{W}.\-]+/)+[{W}.\-]*|(?<![{W}])[{W}\-]+\.(?:php|ya?ml|xml|json|twig|xlf|css|js|ts|md|lock|neon)(?![{W}])",
]


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(text):
    return [(m.start(), m.group()) for m in WORD.finditer(text) if len(m.group()) >= 4]


def cleaned(text):
    """(text, place of each character) after the processors."""
    chars = [(c if c not in "’‘ʼ\xa0 " else "'" if c in "’‘ʼ" else " ", k) for k, c in enumerate(text)]
    for pattern in STEPS:
        shown, out, at = "".join(c for c, _ in chars), [], 0
        for m in regex.finditer(pattern, shown):
            out += chars[at : m.start()] + [(" ", None)]
            at = m.end()
        chars = out + chars[at:]
    return "".join(c for c, _ in chars), [k for _, k in chars]


def brute_force(sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    bench = {w.lower() for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist() for _, w in words(r["text"])}
    held = defaultdict(Counter)
    for d in docs:
        held[d["lang"]].update({w.lower() for _, w in words(d["text"])})
    known = {lang: {w for w, n in c.items() if n >= 20} | bench for lang, c in held.items()}
    entries = defaultdict(set)
    for w in set().union(*known.values()):
        entries[w[0]].add(w)
    best, seen, out = {}, set(), []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        text, places = cleaned(d["text"])
        for start, w in words(text):
            low = w.lower()
            parts = [p for p in regex.split("['-]", low) if len(p) > 1] if "'" in low or "-" in low else []
            if low in known[d["lang"]] or (len(parts) > 1 and all(p in known[d["lang"]] for p in parts)):
                continue
            if low not in best:
                near = [(distance(low.encode(), e.encode()), len(e), e) for e in entries[low[0]] if abs(len(e) - len(low)) <= 2]
                best[low] = ", ".join([e for n, _, e in sorted(x for x in near if x[0] <= 2)][:3])
            at = places[start]
            line, col = d["text"].count("\n", 0, at) + 1, at - d["text"].rfind("\n", 0, at)
            print_ = hashlib.sha256(f"v1|document|id={d['doc_id']}|{low}|spelling".encode()).hexdigest()[:16]
            if (print_, line, col) not in seen:
                seen.add((print_, line, col))
                out.append((w, best[low], d["lang"], f"documents/{d['doc_id']}", line, col, print_))
    return out


def test_whole_run_equals_plain_python(spark, sf):
    rows = [tuple(r) for r in catalogue.QUERIES["whole_run"](spark, sf).collect()]
    wanted = brute_force(sf)
    assert sorted(rows) == sorted(wanted)
    order = [(path, line, col, w) for w, _, _, path, line, col, _ in rows]
    assert order == sorted(order)


def test_findings_are_in_order(spark, sf):
    rows = catalogue.QUERIES["sorted_findings"](spark, sf).collect()
    order = [(f"documents/{r['doc_id']}", r["line"], r["col"], r["word"]) for r in rows]
    assert len(order) > 1000 and order == sorted(order)
