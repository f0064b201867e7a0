"""The named queries over the driver tables, each with a DuckDB twin where SQL can say it.

Dictionaries are derived from the corpus: the words found in MIN_DOCS or more
documents of a language, and, for all languages, the words of the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.functions import offsets as O
from lexora.functions import patterns as P
from lexora.functions import text as T
from lexora.operators import dictionary as D
from lexora.operators import docblock, icu, locators, phpscan, report, spellers, suppression, tokenizers
from lexora.operators import findings as R
from lexora.operators import processors as PR
from lexora.plans.runner import Runner
from lexora.sources import fragments as S
from lexora.staging import shared_dir, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MIN_DOCS = 20


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def literal(text: str) -> str:
    return text.replace("'", "''")


# --- inputs and their SQL -----------------------------------------------------

#: Tokens of the documents with their place; shared by most twins.
SQL_TOKENS = f"""
raw AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{literal(P.PROSE_RE2)}') AS m, string_split_regex(text, '{literal(P.PROSE_RE2)}') AS g FROM documents),
placed AS (SELECT doc_id, lang, text, unnest(m) AS word, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM raw),
every AS (SELECT doc_id, lang, text, word, i, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS BIGINT) AS off FROM placed),
tokens AS (SELECT doc_id, lang, text, word, off, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS idx FROM every WHERE length(word) >= 4)
"""
SQL_WORDS = f"""
words AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{literal(P.PROSE_RE2)}')) AS word FROM documents)
"""
SQL_DICT = f"""
dict AS (SELECT lang, lower(word) AS word FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
bench AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '{literal(P.PROSE_RE2)}')) AS w FROM benchmark) WHERE length(w) >= 4),
known AS (SELECT lang, word FROM dict UNION SELECT lang, word FROM bench CROSS JOIN (SELECT DISTINCT lang FROM documents))
"""
#: Unknown words: not known, and no compound of two or more known parts.
SQL_UNKNOWN = f"""
missing AS (SELECT t.* FROM tokens t LEFT JOIN known k ON t.lang = k.lang AND lower(t.word) = k.word WHERE k.word IS NULL),
parts AS (SELECT lang, word, unnest(string_split_regex(word, '[''-]')) AS p FROM (SELECT DISTINCT lang, lower(word) AS word FROM missing WHERE regexp_matches(word, '[''-]'))),
compounds AS (SELECT p.lang, p.word FROM parts p LEFT JOIN known k ON p.lang = k.lang AND p.p = k.word WHERE length(p.p) > 1 GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) = count(k.word)),
unknown AS (SELECT m.* FROM missing m LEFT JOIN compounds c ON m.lang = c.lang AND lower(m.word) = c.word WHERE c.word IS NULL)
"""
SQL_PRINT = "substr(sha256('v1|document|id=' || doc_id || '|' || lower(word) || '|spelling'), 1, 16)"
SQL_FOUND = f"""
found AS (SELECT doc_id, lang, word, idx, off, text, {SQL_PRINT} AS fingerprint,
  CAST(length(text[:off]) - length(replace(text[:off], chr(10), '')) + 1 AS INTEGER) AS line,
  CAST(length(string_split(text[:off], chr(10))[-1]) + 1 AS INTEGER) AS col FROM unknown)
"""
SQL_ALL = f"WITH {SQL_TOKENS}, {SQL_DICT}, {SQL_UNKNOWN}, {SQL_FOUND}"
#: The same for a dictionary without the words of the benchmark: known0, unknown0, found0.
SQL_BEFORE = "known0 AS (SELECT lang, word FROM dict), " + re.sub(r"\b(known|missing|parts|compounds|unknown|found)\b", r"\g<1>0", f"{SQL_UNKNOWN}, {SQL_FOUND}")
SQL_BOTH = f"{SQL_ALL}, {SQL_BEFORE}"
SQL_EXCERPT = """CASE WHEN b > 0 THEN '...' ELSE '' END || trim(regexp_replace(text[b + 1 : b + length(word) + 64], '[\\p{Z}\\t\\n\\x0B\\f\\r\\x{85}]+', ' ', 'g')) || CASE WHEN off + length(word) + 32 < length(text) THEN '...' ELSE '' END"""


def document_fragments(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    place = F.struct(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("logical"))
    return docs.select(*S.fragment(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.col("text"), F.col("lang"), "document", F.create_map(F.lit("id"), F.col("doc_id").cast("string")), place))


def tokens(spark: SparkSession, sf: str, excerpts: bool = False) -> DataFrame:
    """A row per word with its place; what its excerpt is made of on demand. The text stays behind."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), "text")
    rows = tokenizers.prose_words.words(docs, ["doc_id", "language"], tokenizers.MIN_LENGTH, "text", excerpts)
    return rows.withColumnRenamed("original_column", "column").drop("original_line")


def plain_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words without their places, for counts."""
    found = F.filter(F.regexp_extract_all("text", F.lit(P.PROSE), F.lit(0)), lambda w: F.length(w) >= tokenizers.MIN_LENGTH)
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), F.explode(found).alias("word"))


def doc_words(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, language, lower-cased word, n: a row per document and distinct word."""
    docs = table(spark, sf, "documents")
    rows = tokenizers.prose_words.counted(docs.select("doc_id", F.col("lang").alias("language"), "text"), ["doc_id", "language"], tokenizers.MIN_LENGTH)
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id", "language", "word").agg(F.sum("n").alias("n"))  # a document in several rows


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """language, lower-cased word, n (how often it stands), docs (documents that have it); staged."""
    return stage(doc_words(spark, sf).groupBy("language", "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")), "vocabulary")


def benchmark_words(spark: SparkSession, sf: str) -> DataFrame:
    found = F.filter(F.regexp_extract_all("text", F.lit(P.PROSE), F.lit(0)), lambda w: F.length(w) >= tokenizers.MIN_LENGTH)
    return table(spark, sf, "benchmark").select(F.explode(found).alias("word")).select(F.lower("word").alias("word")).distinct()


def corpus_dictionary(spark: SparkSession, sf: str, bench: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    """word, language, pos, source; pos is an order that doesn't depend on partitions. Staged, as it is read often; bench: also the words of the benchmark; vocab: vocabulary(), if it is there."""
    vocab = vocab if vocab is not None else vocabulary(spark, sf)
    rows = vocab.where(F.col("docs") >= MIN_DOCS).select("word", "language", F.lit("corpus").alias("source"))
    if bench:
        rows = rows.unionByName(benchmark_words(spark, sf).select("word", F.lit(None).cast("string").alias("language"), F.lit("benchmark").alias("source")))
    return stage(rows.select("word", "language", F.lit(0).cast("long").alias("pos"), "source"), "dictionary")


def languages_of(spark: SparkSession, sf: str) -> list[str]:
    return [r[0] for r in table(spark, sf, "documents").select("lang").distinct().collect()]  # a handful


def known_words(spark: SparkSession, sf: str, bench: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    return stage(D.for_languages(corpus_dictionary(spark, sf, bench, vocab), languages_of(spark, sf)), "known")


def accepted_words(spark: SparkSession, sf: str, bench: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    """(language, word) of the known words and of the compounds of such that the documents have; staged."""
    vocab = vocab if vocab is not None else vocabulary(spark, sf)
    return spellers.accepted(vocab, known_words(spark, sf, bench, vocab))


def unknown_words(spark: SparkSession, sf: str, bench: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    """Rows of the vocabulary of the distinct unknown words, lower-cased; staged."""
    vocab = vocab if vocab is not None else vocabulary(spark, sf)
    return stage(spellers.lacking(vocab, accepted_words(spark, sf, bench, vocab)), "unknown")


def unknown_tokens(spark: SparkSession, sf: str, excerpts: bool = False, bench: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    """Tokens that are unknown. Only the accepted words are sent to them: of unknown ones there are more the more text there is."""
    rows = spellers.lacking(tokens(spark, sf, excerpts), accepted_words(spark, sf, bench, vocab))
    if excerpts:
        rows = rows.withColumn("excerpt", T.window(F.col("window"), F.col("cut_before"), F.col("cut_after"))).drop(*tokenizers.prose_words.WINDOW)
    return rows


def found(spark: SparkSession, sf: str, excerpts: bool = False, bench: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    """Findings of the documents, one place per word, without suggestions."""
    rows = unknown_tokens(spark, sf, excerpts, bench, vocab)
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"))
    context = F.struct(F.lit("document").alias("source"), F.create_map(F.lit("id"), F.col("doc_id").cast("string")).alias("attributes"))
    rows = rows.select("*", context.alias("context"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("fragment_id"), F.array().cast("array<string>").alias("suggestions"))
    place = F.struct(path.alias("path"), F.col("line"), F.col("column"), F.lit(None).cast("string").alias("logical"))
    rows = rows.withColumns({"location": place, "seed": T.seed(F.col("context")), "type": F.lit("spelling"), "severity": F.lit("error")})
    return rows.withColumn("fingerprint", T.fingerprint(F.col("seed"), F.col("word")))


def even_baseline(findings: DataFrame) -> DataFrame:
    return R.record(findings.where("doc_id % 2 = 0"))


# --- sources ------------------------------------------------------------------


@query("""
SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS key, lang AS language, CAST(length(text) AS BIGINT) AS length FROM documents
UNION ALL SELECT 'conversations', conv_id || '/' || turn, 'en', CAST(length(text) AS BIGINT) FROM conversations
UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), 'en', CAST(length(text) AS BIGINT) FROM benchmark
""")
def scan_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return _chained(spark, sf).select("context.source", F.element_at("context.attributes", "key").alias("key"), "language", F.length("text").cast("long").alias("length"))


def _chained(spark: SparkSession, sf: str) -> DataFrame:
    def one(name: str, key, language) -> DataFrame:
        df = table(spark, sf, name)
        return df.select(*S.fragment(F.concat_ws("/", F.lit(name), key), F.col("text"), language, name, F.create_map(F.lit("key"), key)))

    talk = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return S.chain(one("documents", F.col("doc_id").cast("string"), F.col("lang")), one("conversations", talk, F.lit("en")), one("benchmark", F.col("item_id").cast("string"), F.lit("en")))


@query("""
SELECT CAST(0 AS INTEGER) AS source_index, count(*) AS fragments, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents
UNION ALL SELECT 1, count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations UNION ALL SELECT 2, count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark
""")
def chain_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _chained(spark, sf).groupBy("source_index").agg(F.count(F.lit(1)).alias("fragments"), F.sum(F.length("text")).cast("long").alias("chars"))


# --- processors ---------------------------------------------------------------

HITS = " It’s ‘so’ %name% and {{ user.name }} or {count}, {} at :userId but a::b; 50%% of %1$s is %05d. See https://x.example/a?b=c or me@mail.example in /usr/local/bin/ now. `code` ![alt](pic.png) [text](link) &amp; <b>bold</b>"
SQL_TEXT = f"text || '{literal(HITS)}'"


def _processed(name: str, pattern: str, sql_text: str, origin: str = "documents", hits: bool = True) -> None:
    key, column = ("doc_id", "text") if origin == "documents" else ("page_id", "html")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, origin).withColumn("t", F.concat(F.col(column), F.lit(HITS)) if hits else F.col(column))
        clean, segments = O.blanked(F.col("t"), pattern)
        return df.select(key, F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("clean_length"))

    run.__name__ = name
    query(f"SELECT {key}, md5(c) AS clean_md5, CAST(length(c) AS BIGINT) AS clean_length FROM (SELECT {key}, {sql_text} AS c FROM {origin})")(run)


@query(f"SELECT doc_id, md5(translate({SQL_TEXT}, '’‘ʼ' || chr(160) || chr(8239), '''''''  ')) AS clean_md5 FROM documents")
def normalize_apostrophe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(PR.normalized(F.concat("text", F.lit(HITS)))).alias("clean_md5"))


_PLACE = literal(r"%[a-zA-Z0-9_.]+%|%%|\{\{[^{}]*\}\}|\{[a-zA-Z0-9_.]*\}")
_processed("strip_placeholders", P.PLACEHOLDER, f"regexp_replace(regexp_replace({SQL_TEXT}, '{_PLACE}', ' ', 'g'), '{literal(f'(^|[^:{P.WORD}]):[a-zA-Z_][{P.WORD}]*')}', '\\1 ', 'g')")
_processed("strip_sprintf", P.SPRINTF, f"regexp_replace({SQL_TEXT}, '{literal(P.SPRINTF)}', ' ', 'g')")
_processed("strip_html", P.HTML, f"regexp_replace(html || '{literal(HITS)}', '{literal(P.HTML_RE2)}', ' ', 'g')", "pages")
_processed("strip_urls", P.URL, f"regexp_replace(regexp_replace({SQL_TEXT}, '{literal(P.URL_RE2_MAIN)}', ' ', 'g'), '{literal(r'(?i)[' + P.WORD + r'-]+[.](?:php|ya?ml|xml|json|twig|xlf|css|js|ts|md|lock|neon)([^' + P.WORD + r']|$)')}', ' \\1', 'g')")
_processed("strip_markdown", P.MARKDOWN, f"regexp_replace({SQL_TEXT}, '{literal(P.MARKDOWN_RE2)}', ' ', 'g')")


#: Rules in numbers only, and brackets that are none; a blank part, and a doubled pipe.
PLURAL_BEFORE, PLURAL_AFTER = "{0} None a||b|]0,1] One| |{name} kept|[beta] kept|{1, 2} few|[2,Inf[ some|[-Inf , 0.5] less| ", "|]1,Inf] many"


@query(f"""
WITH r AS (SELECT doc_id, string_split(replace('{PLURAL_BEFORE}' || text || '{PLURAL_AFTER}', '||', chr(1)), '|') AS m FROM documents),
p AS (SELECT doc_id, i, trim(replace(regexp_replace(x, '^\\s*(\\{{[0-9 ,]+\\}}|[\\[\\]] *-?(Inf|[0-9]+([.][0-9]+)?) *, *-?(Inf|[0-9]+([.][0-9]+)?) *[\\[\\]])\\s*', ''), chr(1), '|'), ' ' || chr(9) || chr(10) || chr(13) || chr(11)) AS v FROM (SELECT doc_id, unnest(m) AS x, unnest(range(len(m))) AS i FROM r))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS part, md5(v) AS part_md5 FROM p WHERE v <> ''
""")
def legacy_plural_split(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit(PLURAL_BEFORE), F.col("text"), F.lit(PLURAL_AFTER))
    return table(spark, sf, "documents").select("doc_id", text.alias("t")).select("doc_id", F.posexplode(PR.plural_parts(F.col("t"))).alias("part", "p")).select("doc_id", "part", F.md5("p.value").alias("part_md5"))


@query(f"""
WITH h AS (SELECT page_id, html, string_split_regex(html, '{literal(P.HTML_RE2)}') AS g, regexp_extract_all(html, '{literal(P.HTML_RE2)}') AS m FROM pages),
seg AS (SELECT page_id, i, gap, CAST(coalesce(sum(length(gap) + 1) OVER w, 0) AS BIGINT) AS out, CAST(coalesce(sum(length(gap) + length(coalesce(hit, ''))) OVER w, 0) AS BIGINT) AS orig
  FROM (SELECT page_id, unnest(g) AS gap, unnest(range(len(g))) AS i, unnest(list_concat(m, [''])) AS hit FROM h) WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT page_id, array_to_string(g, ' ') AS t FROM h),
r AS (SELECT page_id, regexp_extract_all(t, '{literal(P.PROSE_RE2)}') AS m, string_split_regex(t, '{literal(P.PROSE_RE2)}') AS g FROM c),
x AS (SELECT page_id, unnest(m) AS word, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM r),
y AS (SELECT page_id, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY page_id ORDER BY i) - length(word) AS BIGINT) AS "at" FROM x),
z AS (SELECT y.page_id, word, y."at" - s.out + s.orig AS off FROM y JOIN seg s ON y.page_id = s.page_id AND y."at" >= s.out AND y."at" < s.out + length(s.gap) WHERE length(word) >= 4)
SELECT page_id, count(*) AS words, CAST(sum(off) AS BIGINT) AS sum_offset, CAST(max(off) AS BIGINT) AS last_offset FROM z GROUP BY 1
""")
def offsets_through_processors(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    rows = pages.select(*S.fragment(F.col("page_id"), F.col("html"), F.lit("en"), "page", F.create_map(F.lit("id"), F.col("page_id").cast("string"))))
    words = tokenizers.words(PR.html().apply(rows))
    return words.groupBy(F.col("fragment_id").cast("long").alias("page_id")).agg(F.count(F.lit(1)).alias("words"), F.sum("offset").cast("long").alias("sum_offset"), F.max("offset").cast("long").alias("last_offset"))


# --- tokenizers ---------------------------------------------------------------


@query(f"WITH {SQL_WORDS} SELECT lang AS language, word, count(*) AS n FROM words WHERE length(word) >= 4 GROUP BY 1, 2")
def prose_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return plain_words(spark, sf).groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_TOKENS} SELECT doc_id, CAST(idx AS INTEGER) AS word_idx, word, CAST(off AS BIGINT) AS word_offset FROM tokens")
def prose_tokens_with_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf).select("doc_id", "word_idx", "word", F.col("offset").cast("long").alias("word_offset"))


@query(f"""WITH {SQL_TOKENS} SELECT doc_id, CAST(idx AS INTEGER) AS word_idx, CAST(length(text[:off]) - length(replace(text[:off], chr(10), '')) + 1 AS INTEGER) AS line,
CAST(length(string_split(text[:off], chr(10))[-1]) + 1 AS INTEGER) AS col FROM tokens""")
def token_line_column(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf).select("doc_id", "word_idx", "line", F.col("column").alias("col"))


SQL_NAMES = """names AS (SELECT DISTINCT name FROM (
  SELECT event_type AS name FROM events UNION ALL SELECT p_type FROM part UNION ALL SELECT p_brand FROM part
  UNION ALL SELECT replace(p_type, ' ', '') || 'HTTPServer2' || lower(p_brand) || 'deadbeef42' || regexp_replace(p_name, '[^A-Za-z]', '_', 'g') FROM part))"""


def names(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    mixed = F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.lit("HTTPServer2"), F.lower("p_brand"), F.lit("deadbeef42"), F.regexp_replace("p_name", "[^A-Za-z]", "_"))
    each = [table(spark, sf, "events").select(F.col("event_type").alias("name")), part.select(F.col("p_type").alias("name")), part.select(F.col("p_brand").alias("name")), part.select(mixed.alias("name"))]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).distinct()


SQL_SPLIT = f"regexp_extract_all(regexp_replace(name, '{literal(P.IDENTIFIER_RE2_SPLIT)}', '\\1 \\2', 'g'), '{literal(P.IDENTIFIER_RE2)}')"


@query(f"WITH {SQL_NAMES} SELECT name, array_to_string({SQL_SPLIT}, ' ') AS parts FROM names")
def identifier_split(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("name", F.array_join(tokenizers.identifier_parts(F.col("name")), " ").alias("parts"))


@query(f"""WITH {SQL_NAMES}, p AS (SELECT name, unnest({SQL_SPLIT}) AS part FROM names)
SELECT part, count(*) AS n FROM p WHERE length(part) >= 4 AND NOT regexp_matches(part, '^\\p{{Nd}}+$') AND NOT regexp_matches(part, '^[0-9a-fA-F]{{8,}}$') AND (length(part) < 20 OR regexp_matches(part, '(?i)[aeiouy]')) GROUP BY 1""")
def identifier_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select(F.explode(tokenizers.identifier(F.col("name"))).alias("t")).groupBy(F.col("t.text").alias("part")).agg(F.count(F.lit(1)).alias("n"))


# --- languages, dictionaries, spellers ----------------------------------------


@query("""SELECT lang AS language, CASE lang WHEN 'en' THEN 'en_US' WHEN 'de' THEN 'de_AT' WHEN 'es' THEN 'es' END AS resolved,
CASE WHEN lang IN ('en', 'de', 'es') THEN 'ok' ELSE 'missing_dictionary' END AS status, count(*) AS documents FROM documents GROUP BY ALL""")
def resolve_locale(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    resolved = D.resolve_column(docs, "lang", ["de_DE", "en_US", "en_GB", "es"], {"de": "de_AT"})
    return docs.groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("documents")).join(F.broadcast(resolved), "language")


@query(f"WITH {SQL_TOKENS}, {SQL_DICT}, {SQL_UNKNOWN} SELECT lang AS language, lower(word) AS word, count(*) AS n FROM missing GROUP BY 1, 2")
def dictionary_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    # counted first, so that each word is looked up once
    vocab = vocabulary(spark, sf)
    return spellers.lacking(vocab.select("language", "word", "n"), known_words(spark, sf, vocab=vocab))


@query(f"WITH {SQL_TOKENS}, {SQL_DICT} SELECT lang AS language, count(*) AS words FROM known GROUP BY 1")
def dictionary_language_scope(spark: SparkSession, sf: str) -> DataFrame:
    return known_words(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("words"))


#: Compounds of the most frequent words with each word that follows, so that known and unknown parts meet.
@query(f"""WITH {SQL_TOKENS}, {SQL_DICT},
w AS (SELECT DISTINCT lang, lower(word) AS word FROM tokens),
c AS (SELECT lang, word || '-' || lead(word) OVER (PARTITION BY lang ORDER BY word) AS whole FROM w),
p AS (SELECT lang, whole, unnest(string_split_regex(whole, '[''-]')) AS p FROM c WHERE whole IS NOT NULL),
good AS (SELECT p.lang, p.whole FROM p LEFT JOIN known k ON p.lang = k.lang AND p.p = k.word WHERE length(p.p) > 1 GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) = count(k.word))
SELECT DISTINCT lang AS language, whole AS word FROM c WHERE whole IS NOT NULL AND (lang, whole) NOT IN (SELECT lang, whole FROM good) AND (lang, whole) NOT IN (SELECT lang, word FROM known)""")
def compound_words(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    words = vocabulary(spark, sf)
    follow = words.select("language", "word").withColumn("next", F.lead("word").over(Window.partitionBy("language").orderBy("word"))).where("next is not null")
    compounds = follow.select("language", F.concat_ws("-", "word", "next").alias("word")).distinct()
    return spellers.unknown(compounds, known_words(spark, sf, vocab=words))


SQL_BEST = f"""
u AS (SELECT DISTINCT lower(word) AS word FROM unknown), e AS (SELECT DISTINCT word AS candidate FROM (SELECT word FROM dict UNION SELECT word FROM bench)),
near AS (SELECT u.word, candidate, levenshtein(u.word, candidate) AS d FROM u JOIN e ON u.word[1] = candidate[1] AND abs(length(u.word) - length(candidate)) <= 2 WHERE levenshtein(u.word, candidate) <= 2),
ranked AS (SELECT word, candidate, row_number() OVER (PARTITION BY word ORDER BY d, length(candidate), candidate) AS r FROM near),
best AS (SELECT word, array_to_string(list(candidate ORDER BY r), ', ') AS suggestions FROM ranked WHERE r <= 3 GROUP BY 1)
"""


@query(f"WITH {SQL_TOKENS}, {SQL_DICT}, {SQL_UNKNOWN}, {SQL_BEST} SELECT word, suggestions FROM best")
def suggest_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf).select("word", F.array_join("suggestions", ", ").alias("suggestions"))


def _best(spark: SparkSession, sf: str) -> DataFrame:
    vocab = vocabulary(spark, sf)
    return spellers.suggestions(unknown_words(spark, sf, vocab=vocab).select("word").distinct(), corpus_dictionary(spark, sf, vocab=vocab))


@query(f"""WITH {SQL_TOKENS}, {SQL_DICT}, {SQL_UNKNOWN}, {SQL_BEST},
one AS (SELECT word, string_split(suggestions, ', ')[1] AS s FROM best)
SELECT word, 'get' || replace(upper(s[1]), 'ẞ', 'SS') || s[2:] || 'Name' AS camel, replace(upper(s), 'ẞ', 'SS') || '_ID' AS shout FROM one""")
def suggestion_formatter(spark: SparkSession, sf: str) -> DataFrame:
    first = F.slice("suggestions", 1, 1)
    word = F.col("word")
    capital = F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))
    rows = _best(spark, sf).select("word", first.alias("s"), capital.alias("capital"), F.upper("word").alias("shouted"))
    camel = spellers.formatted(F.col("capital"), F.col("s"), F.concat(F.lit("get"), F.col("capital"), F.lit("Name")))
    shout = spellers.formatted(F.col("shouted"), F.col("s"), F.concat(F.col("shouted"), F.lit("_ID")))
    return rows.select("word", F.element_at(camel, 1).alias("camel"), F.element_at(shout, 1).alias("shout"))


@query(f"WITH {SQL_TOKENS}, {SQL_DICT}, {SQL_UNKNOWN} SELECT doc_id, count(*) AS unknown_words, count(DISTINCT lower(word)) AS distinct_unknown FROM unknown GROUP BY 1")
def cached_check_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct word is checked once and fanned out to where it stands."""
    rows = spellers.lacking(doc_words(spark, sf), accepted_words(spark, sf))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("unknown_words"), F.count(F.lit(1)).alias("distinct_unknown"))


# --- findings -----------------------------------------------------------------


@query(f"{SQL_ALL} SELECT fingerprint, count(*) AS n FROM found GROUP BY 1")
def finding_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = spellers.lacking(doc_words(spark, sf), accepted_words(spark, sf))
    seed = F.concat(F.lit("document|id="), F.col("doc_id").cast("string"))
    return rows.groupBy(T.fingerprint(seed, F.col("word")).alias("fingerprint")).agg(F.sum("n").alias("n"))


@query(f"""{SQL_ALL}, x AS (SELECT *, greatest(0, off - 32) AS b FROM found)
SELECT doc_id, CAST(idx AS INTEGER) AS word_idx, md5(CASE WHEN b > 0 THEN '...' ELSE '' END || trim(regexp_replace(text[b + 1 : b + length(word) + 64], '[\\p{{Z}}\\t\\n\\x0B\\f\\r\\x{{85}}]+', ' ', 'g')) || CASE WHEN off + length(word) + 32 < length(text) THEN '...' ELSE '' END) AS excerpt_md5 FROM x""")
def finding_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return unknown_tokens(spark, sf, excerpts=True).select("doc_id", "word_idx", F.md5("excerpt").alias("excerpt_md5"))


@query(f"{SQL_ALL} SELECT doc_id, CAST(idx AS INTEGER) AS word_idx, word, line, col, fingerprint FROM found")
def sorted_findings(spark: SparkSession, sf: str) -> DataFrame:
    return R.ordered(found(spark, sf)).select("doc_id", "word_idx", "word", F.col("location.line").alias("line"), F.col("location.column").alias("col"), "fingerprint")


@query(f"{SQL_ALL} SELECT word, count(*) AS n FROM found WHERE NOT regexp_matches(word, '^\\p{{Lu}}+$') AND NOT regexp_matches(word, '(.)ing$') GROUP BY 1")
def filter_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return R.pattern_filter([r"^\p{Lu}+$", "(.)ing$"]).apply(unknown_tokens(spark, sf)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SQL_ALL}, d AS (SELECT fingerprint, line, min(idx) AS idx FROM found GROUP BY 1, 2) SELECT fingerprint, line, CAST(idx AS INTEGER) AS word_idx FROM d")
def filter_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of code carry no column: equal words of a line collapse to the first."""
    rows = found(spark, sf).select("fingerprint", F.struct(F.col("location.path").alias("path"), F.col("location.line").alias("line"), F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("logical")).alias("location"), "fragment_id", "word_idx")
    return R.deduplication_filter().apply(rows).select("fingerprint", F.col("location.line").alias("line"), "word_idx")


@query(f"{SQL_ALL} SELECT doc_id, count(*) AS n FROM found WHERE fingerprint NOT IN (SELECT fingerprint FROM found WHERE doc_id % 2 = 0) GROUP BY 1")
def filter_baseline(spark: SparkSession, sf: str) -> DataFrame:
    rows = found(spark, sf)
    return R.baseline_filter(even_baseline(rows)).apply(rows.select("doc_id", "fingerprint")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _before_and_after(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vocab = vocabulary(spark, sf)
    return R.record(found(spark, sf, bench=False, vocab=vocab)), found(spark, sf, vocab=vocab)


#: A baseline of all documents from before the words of the benchmark were in the dictionary, and a run of all documents after.
@query(f"{SQL_BOTH} SELECT DISTINCT fingerprint FROM found0 WHERE fingerprint NOT IN (SELECT fingerprint FROM found)")
def baseline_outdated(spark: SparkSession, sf: str) -> DataFrame:
    return R.outdated(*_before_and_after(spark, sf)).select("fingerprint")


@query(f"{SQL_BOTH} SELECT DISTINCT fingerprint FROM found0 WHERE fingerprint IN (SELECT fingerprint FROM found)")
def baseline_prune(spark: SparkSession, sf: str) -> DataFrame:
    return R.pruned(*_before_and_after(spark, sf)).select("fingerprint")


@query(f"""{SQL_BOTH}, a AS (SELECT fingerprint, arg_max(word, idx) AS word FROM found0 GROUP BY 1), b AS (SELECT fingerprint, arg_max(word, idx) AS word FROM found GROUP BY 1)
SELECT fingerprint, CASE WHEN b.word IS NULL THEN 'first' ELSE 'second' END AS seen_at, coalesce(b.word, a.word) AS word FROM a FULL JOIN b USING (fingerprint)""")
def baseline_merge(spark: SparkSession, sf: str) -> DataFrame:
    vocab = vocabulary(spark, sf)
    return R.merged(R.record(found(spark, sf, bench=False, vocab=vocab), seen_at="first"), R.record(found(spark, sf, vocab=vocab), seen_at="second")).select("fingerprint", "seen_at", "word")


@query(f"{SQL_BOTH} SELECT lang AS language, lower(word) AS word, count(*) AS n FROM found0 WHERE lower(word) NOT IN (SELECT word FROM bench) GROUP BY 1, 2")
def filter_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Findings against the words of the corpus, less those in the words of the benchmark."""
    vocab = vocabulary(spark, sf)  # findings by word; the filter looks at nothing else of them
    bench = D.for_languages(corpus_dictionary(spark, sf, vocab=vocab).where("source = 'benchmark'"), languages_of(spark, sf))
    return R.chain(unknown_words(spark, sf, bench=False, vocab=vocab), [R.dictionary_filter(bench)]).select("language", "word", "n")


@query(f"{SQL_BOTH} SELECT DISTINCT lang AS language, lower(word) AS word FROM unknown0 WHERE lang = 'en' UNION SELECT DISTINCT lang, lower(word) FROM unknown WHERE lang <> 'en'")
def chain_speller(spark: SparkSession, sf: str) -> DataFrame:
    """English is known to the first speller, with the corpus' own words; other languages fall to the second."""
    words = vocabulary(spark, sf)
    english = D.clean(corpus_dictionary(spark, sf, bench=False, vocab=words).where("language = 'en'"))
    speller = spellers.ChainSpeller([spellers.WordListSpeller(english, only=("en",)), spellers.WordListSpeller(corpus_dictionary(spark, sf, vocab=words))])
    return speller.check(words, with_suggestions=False).select("language", "word")


# --- statistics ---------------------------------------------------------------


#: The words of the documents, checked through a cache, and then those of the conversations; the rate is that of both.
@query(f"""WITH {SQL_WORDS}, w AS (SELECT * FROM words WHERE length(word) >= 4), a AS (SELECT DISTINCT lang, lower(word) AS word FROM w),
t AS (SELECT DISTINCT 'en' AS lang, lower(x) AS word FROM (SELECT unnest(regexp_extract_all(text, '{literal(P.PROSE_RE2)}')) AS x FROM conversations) WHERE length(x) >= 4)
SELECT (SELECT count(*) FROM documents) AS fragments, (SELECT count(DISTINCT doc_id) FROM documents) AS files_scanned, count(*) AS words_checked, count(DISTINCT lang || '|' || lower(word)) AS unique_words_checked,
(SELECT count(*) FROM t JOIN a USING (lang, word)) AS cache_hits, (SELECT count(*) FROM a) + (SELECT count(*) FROM t ANTI JOIN a USING (lang, word)) AS cache_misses,
round((SELECT count(*) FROM t JOIN a USING (lang, word)) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM t)), 4) AS cache_hit_rate FROM w""")
def run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    speller = spellers.CachingSpeller(spellers.WordListSpeller(corpus_dictionary(spark, sf)), shared_dir(spark, "speller-cache"))
    found_ = F.filter(F.regexp_extract_all("text", F.lit(P.PROSE), F.lit(0)), lambda w: F.length(w) >= tokenizers.MIN_LENGTH)
    talk = table(spark, sf, "conversations").select(F.lit("en").alias("language"), F.explode(found_).alias("word"))
    for words in (plain_words(spark, sf).select("language", "word"), talk):
        speller.check(words, with_suggestions=False)
    rows = R.statistics(document_fragments(spark, sf), plain_words(spark, sf), hits=speller.hits, misses=speller.misses)
    return rows.select("fragments", "files_scanned", "words_checked", "unique_words_checked", "cache_hits", "cache_misses", F.col("cache_hit_rate").cast("double").alias("cache_hit_rate"))


@query(f"WITH {SQL_WORDS} SELECT lang AS language, count(*) AS words FROM words WHERE length(word) >= 4 GROUP BY 1")
def words_per_language(spark: SparkSession, sf: str) -> DataFrame:
    counts = R.statistics(document_fragments(spark, sf), plain_words(spark, sf)).select(F.explode("words_per_language").alias("language", "words"))
    return counts


@query(f"WITH {SQL_WORDS} SELECT lang AS language, count(DISTINCT lower(word)) AS unique_words FROM words WHERE length(word) >= 4 GROUP BY 1")
def unique_words(spark: SparkSession, sf: str) -> DataFrame:
    return plain_words(spark, sf).select("language", F.lower("word").alias("word")).distinct().groupBy("language").agg(F.count(F.lit(1)).alias("unique_words"))


@query(f"{SQL_ALL} SELECT CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code, count(*) AS findings FROM found")
def exit_code(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count(F.lit(1))
    return unknown_tokens(spark, sf).agg(F.when(n > 0, R.exit_code(1, [])).otherwise(R.exit_code(0, [])).alias("exit_code"), n.alias("findings"))


# --- reports ------------------------------------------------------------------


@query(f"{SQL_ALL} SELECT '::error file=documents/' || doc_id || ',line=' || line || ',col=' || col || ',title=Spelling::Unknown word \"' || word || '\"' AS value FROM found")
def report_github(spark: SparkSession, sf: str) -> DataFrame:
    return report.github(found(spark, sf))


@query(f"""{SQL_ALL}, x AS (SELECT *, greatest(0, off - 32) AS b FROM found)
SELECT '"' || lang || '","","","' || replace(CASE WHEN b > 0 THEN '...' ELSE '' END || trim(regexp_replace(text[b + 1 : b + length(word) + 64], '[\\p{{Z}}\\t\\n\\x0B\\f\\r\\x{{85}}]+', ' ', 'g')) || CASE WHEN off + length(word) + 32 < length(text) THEN '...' ELSE '' END, '"', '""')
  || '","' || word || '","","documents/' || doc_id || '","' || line || '"' AS value FROM x""")
def report_csv(spark: SparkSession, sf: str) -> DataFrame:
    return report.csv(found(spark, sf, excerpts=True))


@query(f"""{SQL_ALL} SELECT '{{"description":"Unknown word \\"' || word || '\\"","check_name":"spelling","fingerprint":"' || fingerprint || '","severity":"minor","location":{{"path":"documents/' || doc_id || '","lines":{{"begin":' || line || '}}}}}}' AS value FROM found""")
def report_gitlab(spark: SparkSession, sf: str) -> DataFrame:
    return report.gitlab(found(spark, sf))


@query(f"""{SQL_ALL} SELECT 'documents/' || doc_id AS file, count(*) AS errors, CAST(sum(line) AS BIGINT) AS lines, md5(string_agg('<error line="' || line || '" column="' || col || '" severity="error" message="Unknown word &quot;' || replace(word, '''', '&#039;') || '&quot;" source="{report.RULE}"/>', '' ORDER BY line, col)) AS body_md5 FROM found GROUP BY 1""")
def report_checkstyle_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.checkstyle(found(spark, sf)).select("file", "value", F.regexp_extract("value", 'line="([0-9]+)"', 1).cast("long").alias("line"), F.regexp_extract("value", 'column="([0-9]+)"', 1).cast("long").alias("col"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("line", "col", "value"))), lambda s: s["value"])
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("errors"), F.sum("line").alias("lines"), F.md5(F.array_join(body, "")).alias("body_md5"))


@query(f"""{SQL_ALL} SELECT word, count(*) AS n FROM found GROUP BY 1""")
def report_junit(spark: SparkSession, sf: str) -> DataFrame:
    cases = report.junit(found(spark, sf, excerpts=True))
    name = F.replace(F.regexp_extract("value", '^<testcase name="([^"]*)"', 1), F.lit("&#039;"), F.lit("'"))
    return cases.groupBy(name.alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{SQL_ALL}, x AS (SELECT *, greatest(0, off - 32) AS b FROM found), y AS (SELECT *, {SQL_EXCERPT} AS excerpt FROM x)
SELECT '{{"word":"' || word || '","type":"spelling","suggestions":[],"language":"' || lang || '","context":{{"source":"document","attributes":{{"id":"' || doc_id || '"}}}},"location":{{"path":"documents/' || doc_id || '","line":' || line || ',"column":' || col
  || '}},"excerpt":"' || replace(replace(excerpt, '\\', '\\\\'), '"', '\\"') || '","severity":"error","fingerprint":"' || fingerprint || '"}}' AS value FROM y""")
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    return report.json_rows(found(spark, sf, excerpts=True))


@query(f"""{SQL_ALL}, x AS (SELECT *, line || ':' || col AS place FROM found)
SELECT 'Code' AS "group", 'documents/' || doc_id AS file, '    ' || CASE WHEN length(place) < 14 THEN rpad(place, 14, ' ') ELSE place END || '  ' || CASE WHEN length(word) < 24 THEN rpad(word, 24, ' ') ELSE word END || '  (no suggestion)  ' AS value FROM x""")
def report_table(spark: SparkSession, sf: str) -> DataFrame:
    return report.table(found(spark, sf))


@query("SELECT 'icu_syntax' AS code, 'documents/' || doc_id AS path FROM documents WHERE lang = 'fr'")
def run_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text as a branch of a message, which is not closed in French ones."""
    plain = F.regexp_replace("text", "['{}#|]", " ")
    closed = F.when(F.col("language") == "fr", "").otherwise("}}")
    rows = document_fragments(spark, sf).withColumn("text", F.concat(F.lit("{n, plural, other {"), plain, closed))
    rows = rows.withColumn("context", F.struct(F.lit("translation").alias("source"), F.col("context.attributes").alias("attributes")))
    return R.distinct_diagnostics(PR.icu_diagnostics(rows)).select("code", F.col("location.path").alias("path"))


# --- grammars -----------------------------------------------------------------

ICU_HEAD, ICU_TAIL = "{n, plural, offset:1 =0 {none} one {it''s '{'quoted'}' ", "} other {# more, {kind, select, a {first} other {rest}}}} after"
_AFTER = f"{len(ICU_HEAD)} + length(text)"


@query(f"""
WITH s AS (SELECT doc_id, text, unnest(['none', 'it''s {{quoted}} ' || regexp_replace(text, '[''{{}}#|]', ' ', 'g'), ' more, ', 'first', 'rest', ' after']) AS t,
  unnest([{ICU_HEAD.index("none")}, {ICU_HEAD.index("it'")}, {_AFTER} + {ICU_TAIL.index(" more")}, {_AFTER} + {ICU_TAIL.index("first")}, {_AFTER} + {ICU_TAIL.index("rest")}, {_AFTER} + {ICU_TAIL.index(" after")}]) AS start, unnest(range(6)) AS span FROM documents)
SELECT doc_id, CAST(NULL AS VARCHAR) AS error, CAST(span AS INTEGER) AS span, CAST(start AS INTEGER) AS start, md5(t) AS text_md5 FROM s
""")
def icu_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text inside a plural message: its spans and where they start."""
    message = F.concat(F.lit(ICU_HEAD), F.regexp_replace("text", "['{}#|]", " "), F.lit(ICU_TAIL))
    rows = table(spark, sf, "documents").select("doc_id", icu.expand_udf(message).alias("x"))
    return rows.select("doc_id", "x.error", F.posexplode("x.spans").alias("span", "s")).select("doc_id", "error", "span", F.col("s.start").alias("start"), F.md5("s.text").alias("text_md5"))


DOC_TAIL = "\n * @param int $foo the value {@see x} here\n * @ORM no\n   # @deprecated since then\n// @throws {@see X} $bar */ \n plain {@link a b} end\n */"


@query(rf"""
WITH c AS (SELECT doc_id, unnest(string_split('/**' || chr(10) || ' * ' || replace(text, chr(10), chr(10) || ' * ') || '{literal(DOC_TAIL)}', chr(10))) AS x, unnest(range(length(text) - length(replace(text, chr(10), '')) + 8)) AS i FROM documents),
d AS (SELECT doc_id, i, regexp_replace(regexp_replace(rtrim(x, chr(13)), '^[ \t\n\x0B\f\r]*(/\*\*|/\*|\*/|\*|//|#)', ''), '\*/[ \t\n\x0B\f\r]*$', '') AS x FROM c),
e AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '^[ \t\n\r\x00\x0B]+', ''), '\{{@[^}}]*\}}', ' ', 'g') AS x FROM d),
f AS (SELECT doc_id, i, CASE WHEN x[1] <> '@' THEN x WHEN lower(regexp_extract(x, '^@([a-zA-Z-]+)', 1)) IN ('param', 'return', 'var', 'throws', 'property', 'property-read', 'property-write', 'method', 'deprecated', 'todo', 'note', 'internal')
  THEN regexp_replace(regexp_replace(x, '^@[a-zA-Z-]+', ''), '^\s*(?:[^\s$]+\s+)?(?:\$\w+\s*)?', '') ELSE '' END AS x FROM e),
g AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) || chr(10) AS t FROM f GROUP BY 1)
SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM g
""")
def docblock_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a doc comment with tags."""
    comment = F.concat(F.lit("/**\n * "), F.replace("text", F.lit("\n"), F.lit("\n * ")), F.lit(DOC_TAIL))
    rows = table(spark, sf, "documents").select("doc_id", docblock.clean_udf()(comment).alias("d"))
    return rows.select("doc_id", F.md5("d.text").alias("text_md5"), F.length("d.text").alias("n_chars"))


def _php_files(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    camel = F.regexp_replace(F.initcap("p_name"), "[^A-Za-z]", "")
    code = F.concat(F.lit("<?php\nnamespace Shop\\Part;\n/** A "), F.col("p_name"), F.lit(". */\nfinal class "), camel, F.lit("\n{\n    // @lexora-ignore-next-line\n    private int $hiddn = 0;\n    public const BRAND = '"), F.col("p_brand"), F.lit("';\n    public function get"), camel, F.lit("(int $size, private string $kind = 'x'): int { return $size; }\n}\n"))
    return part.select(F.concat(F.lit("src/Part"), F.col("p_partkey").cast("string"), F.lit(".php")).alias("path"), code.alias("code"))


@query("""
WITH p AS (SELECT p_partkey, p_name, p_brand, regexp_replace(array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ''), '[^A-Za-z]', '', 'g') AS camel FROM part),
r AS (SELECT 'src/Part' || p_partkey || '.php' AS path, unnest(['docblock', 'class_like', 'constant', 'method', 'parameter', 'property', NULL]) AS kind,
  unnest(['/** A ' || p_name || '. */', camel, 'BRAND', 'get' || camel, 'size', 'kind', NULL]) AS value, unnest([3, 4, 8, 9, 9, 9, NULL]) AS line, unnest([0, 0, 0, 0, 0, 0, 2]) AS suppressed FROM p)
SELECT path, kind, value, CAST(line AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS error, CAST(suppressed AS BIGINT) AS suppressed FROM r
""")
def php_scan(spark: SparkSession, sf: str) -> DataFrame:
    files = _php_files(spark, sf).select("path", F.encode("code", "UTF-8").alias("content"))
    return phpscan.scan(files)


@query("""
SELECT 'src/Part' || p_partkey || '.php' AS path, unnest([6, 7]) AS line FROM part
""")
def suppressed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return suppression.ignored_lines(_php_files(spark, sf))


@query("""
WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_brand FROM part)
SELECT p_partkey, CAST(n + 1 AS INTEGER) AS line, 'lang/' || replace(p_brand, '#', '_') || '.en.yaml' AS path FROM r
""")
def key_locators(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue per brand with a key per part; each key is located by join."""
    part = table(spark, sf, "part")
    domain = F.replace("p_brand", F.lit("#"), F.lit("_"))
    # a catalogue is a file: it holds the parts of one brand
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda r: F.concat(F.lit("    k"), r["p_partkey"].cast("string"), F.lit(": \""), r["p_name"], F.lit('"'))), "\n")
    files = part.groupBy(domain.alias("domain")).agg(body.alias("body")).select(F.concat(F.lit("lang/"), F.col("domain"), F.lit(".en.yaml")).alias("path"), F.concat(F.lit("part:\n"), F.col("body")).alias("text"))
    wanted = part.select("p_partkey", domain.alias("domain"), F.lit("en").alias("locale"), F.concat(F.lit("part.k"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"))
    return locators.locate(wanted, files).select("p_partkey", "line", "path")


def _catalogues(spark: SparkSession, suffix: str, head: str, line: Column, tail: str) -> Callable[[DataFrame], DataFrame]:
    """A file per brand of part with a line per part, in the order of keys."""

    def build(part: DataFrame) -> DataFrame:
        rows = part.select(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("domain"), F.struct("p_partkey", line.alias("line")).alias("r"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
        return rows.groupBy("domain").agg(body.alias("body")).select(F.concat(F.lit("lang/"), F.col("domain"), F.lit(f".en.{suffix}")).alias("path"), F.concat(F.lit(head), F.col("body"), F.lit(tail)).alias("text"))

    return build


def _sql_lines(suffix: str, head: int, asked: str) -> str:
    return f"""WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_brand FROM part)
SELECT p_partkey, asked, CAST(n + {head} AS INTEGER) AS line, 'lang/' || replace(p_brand, '#', '_') || '.en.{suffix}' AS path FROM r CROSS JOIN (SELECT unnest([{asked}]) AS asked)"""


def _asked(part: DataFrame, what: dict[str, tuple[Column, Column]]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("asked"), key.alias("key"), value.alias("value")) for name, (key, value) in what.items()]))
    return part.select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("_")).alias("domain"), F.lit("en").alias("locale"), each.alias("w")).select("p_partkey", "domain", "locale", "w.*")


@query(_sql_lines("xlf", 2, "'resname', 'id', 'source', 'target'"))
def key_locators_xliff(spark: SparkSession, sf: str) -> DataFrame:
    part, key = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    name = F.concat(F.col("p_name"), F.lit(" & no. "), key)
    line = F.concat(F.lit('<trans-unit id="u'), key, F.lit('" resname="part.k'), key, F.lit('"><source>'), F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit('</source><target state="final">T&quot;'), key, F.lit("</target></trans-unit>"))
    files = _catalogues(spark, "xlf", '<?xml version="1.0"?>\n<xliff>\n', line, "\n</xliff>")(part)
    none = F.lit("none")
    what = {"resname": (F.concat(F.lit("part.k"), key), none), "id": (F.concat(F.lit("u"), key), none), "source": (name, none), "target": (none, F.concat(F.lit('T"'), key))}
    return locators.locate(_asked(part, what), files).select("p_partkey", "asked", "line", "path")


@query(_sql_lines("php", 2, "'single', 'double'"))
def key_locators_php(spark: SparkSession, sf: str) -> DataFrame:
    part, key = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    line = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("    'it\\'s.k"), key, F.lit("' => "))).otherwise(F.concat(F.lit('    "it\'s.k'), key, F.lit('" => '))), F.lit("'a' . 'b',"))
    files = _catalogues(spark, "php", "<?php\nreturn [\n", line, "\n];\n")(part)
    wanted = F.concat(F.lit("it's.k"), key)
    return locators.locate(_asked(part, {"single": (wanted, F.lit("none")), "double": (wanted, F.lit("other"))}), files).select("p_partkey", "asked", "line", "path")


@query()
def whole_run(spark: SparkSession, sf: str) -> DataFrame:
    """The runner from end to end over all documents: processors, speller with suggestions, filters, order."""
    speller = spellers.WordListSpeller(corpus_dictionary(spark, sf))
    available = [r[0] for r in table(spark, sf, "documents").select("lang").distinct().collect()]
    done = Runner(speller, processors=[PR.normalize_apostrophe(), PR.placeholder(), PR.sprintf(), PR.html(), PR.url()], available=available).run(document_fragments(spark, sf))
    return done.findings.select("word", F.array_join("suggestions", ", ").alias("suggestions"), "language", F.col("location.path").alias("path"), F.col("location.line").alias("line"), F.col("location.column").alias("col"), "fingerprint")
