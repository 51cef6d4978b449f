"""Queries over texts: tokens, hashes, search, line finding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunker, findings, kb, search, web
from ..session import load, spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TERMS = ["the", "que", "und", "la"]
#: White space as in functions.text.SPACE, for RE2.
WS = r"\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


TOKENS = rf"list_filter(string_split_regex(lower(text), '[{WS},，、;；|/]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def fn_tokens(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(tx.search_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(tx.search_terms(F.col("text"))).cast("long").alias("n_terms"))


@query("""
SELECT doc_id, octet_length(encode(text)) AS bytes, CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END AS short, contains(lower(text), 'the ')::int + contains(lower(text), ' que')::int AS score,
 trim(regexp_replace(text, '[""" + WS + """]+', ' ', 'g')) AS squeezed, length(replace(text, 'the', 'THE')) AS replaced, (length(text) - length(replace(text, 'the', ''))) // 3 AS n_replaced FROM documents
""")
def fn_text(spark, d):
    new, n = tx.replace_counted(F.col("text"), "the", "THE")
    return load(spark, d, "documents").select(
        "doc_id", F.octet_length("text").cast("long").alias("bytes"), tx.truncate(F.col("text"), 60).alias("short"), tx.match_score(F.col("text"), ["the ", " QUE"]).alias("score"), tx.squeeze(F.col("text")).alias("squeezed"),
        F.length(new).cast("long").alias("replaced"), n.alias("n_replaced"),
    )


@query("SELECT item_id, 'Item ' || cast(item_id AS varchar) || ': ' || text AS filled, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM benchmark")
def fn_template(spark, d):
    filled = tx.substitute(F.lit("Item {{id}}: {{text}}"), {"id": F.col("item_id"), "text": F.col("text")})
    return load(spark, d, "benchmark").select("item_id", filled.alias("filled"), tx.escape_xml(F.col("text")).alias("escaped"))


@query("SELECT doc_id, substring(sha1('1200' || chr(0) || text), 1, 12) AS hash, 'kb:' || substring(sha1(chr(0) || source), 1, 12) AS source_id FROM documents")
def fn_content_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text"), "1200").alias("hash"), kb.doc_id(F.col("source")).alias("source_id"))


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


_SLUG = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g'), '[\\\\/:*?\"<>|\\x00-\\x1f]', '-', 'g'), '[{WS}]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""
SELECT doc_id, substring({_SLUG}, 1, 80) AS slug, CASE WHEN length(e) > 180 THEN left(e, 180) || '…' ELSE e END AS excerpt FROM (SELECT doc_id, text, CASE WHEN c = '' THEN {_squeezed('text')} ELSE c END AS e
 FROM (SELECT doc_id, text, array_to_string(list_slice(CASE WHEN len(p) > 0 THEN p ELSE l END, 1, 2), ' ') AS c FROM (SELECT *, list_filter(l, lambda v: NOT contains(v, '](') AND NOT starts_with(v, '#') AND NOT regexp_matches(v, '^({tx.MENU})')) AS p
  FROM (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda v: {_squeezed('v')}), lambda v: length(v) >= 20) AS l FROM documents))))
""")
def fn_slug_excerpt(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug"), tx.excerpt(F.col("text")).alias("excerpt"))


_BM25 = """
toks{s} AS (SELECT {key} AS id, {tokens} AS t FROM {table}), shape{s} AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks{s}),
tf{s} AS (SELECT id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM toks{s}, (SELECT unnest({terms}) AS term)),
df{s} AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf{s} GROUP BY 1),
bm{s} AS (SELECT id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score FROM tf{s} JOIN df{s} USING (term), shape{s} GROUP BY id)
"""


def _bm25_sql(table: str, key: str, column: str, terms: list[str], s: str = "") -> str:
    return _BM25.format(table=table, key=key, tokens=TOKENS.replace("text", column), terms=str(terms), s=s)


@query("WITH " + _bm25_sql("documents", "doc_id", "text", TERMS) + " SELECT id AS doc_id, round(score, 6) AS score FROM bm")
def search_bm25(spark, d):
    return search.bm25(spread(load(spark, d, "documents")), "doc_id", "text", TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query("WITH " + _bm25_sql("documents", "doc_id", "text", TERMS) + " SELECT id AS doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 8")
def search_top_k(spark, d):
    scored = search.bm25(spread(load(spark, d, "documents")), "doc_id", "text", TERMS).select("doc_id", F.round("score", 6).alias("score"))
    return search.top_k(scored, "doc_id")


_HEAD = ["src1", "en", "de"]


@query(
    "WITH " + _bm25_sql("documents", "doc_id", "text", TERMS + _HEAD) + ", " + _bm25_sql("(SELECT doc_id, source || ' ' || lang AS head FROM documents)", "doc_id", "head", TERMS + _HEAD, "2")
    + " SELECT a.id AS doc_id, round(0.75 * a.score / (SELECT max(score) FROM bm) + 0.25 * b.score / (SELECT max(score) FROM bm2), 6) AS score FROM bm a JOIN bm2 b USING (id) WHERE a.score > 0 OR b.score > 0"
)
def search_two_routes(spark, d):
    docs = spread(load(spark, d, "documents")).withColumn("head", F.concat_ws(" ", "source", "lang"))
    return search.two_routes(docs, "doc_id", "text", "head", TERMS + _HEAD).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""
WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents) SELECT token, count(*) AS df, (SELECT count(*) FROM t) AS n_docs, (SELECT round(avg(len(t)), 6) FROM t) AS avgdl FROM (SELECT unnest(list_distinct(t)) AS token FROM t) GROUP BY 1
""")
def search_corpus_stats(spark, d):
    return search.corpus_stats(load(spark, d, "documents"), "text").withColumn("avgdl", F.round("avgdl", 6))


@query("""
SELECT conv_id, turn, n, chars FROM (SELECT conv_id, turn, row_number() OVER w AS n, cast(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bigint) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE n = 1 OR (chars <= 4000 AND n <= 12)
""")
def search_bounded_read(spark, d):
    return search.bounded_read(load(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.col("n").cast("long").alias("n"), "chars")


@query("""
SELECT doc_id, line, before, content, after FROM (SELECT doc_id, line, content, coalesce(lag(content) OVER w, '') AS before, coalesce(lead(content) OVER w, '') AS after
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY line)) WHERE regexp_matches(content, '(?i)token|@')
""")
def search_find_lines(spark, d):
    hits = web.find_lines(load(spark, d, "documents"), "doc_id", "text", "token|@")
    return hits.select("doc_id", F.col("line").cast("long").alias("line"), F.array_join("before", "").alias("before"), "content", F.array_join("after", "").alias("after"))


@query()
def search_chunks(spark, d):
    return chunker.chunks(spread(load(spark, d, "documents")), "doc_id", "text")


_CLAIMS = """
SELECT item_id, list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(text), '[\\s，。、；：！？,.;:!?"''（）()\\[\\]【】]+', ' ', 'g'), ' '), lambda x: x <> ''),
 lambda w: CASE WHEN regexp_matches(w, '^[a-z0-9]+$') THEN CASE WHEN length(w) >= 3 THEN [w] ELSE [] END WHEN length(w) >= 2 THEN list_transform(generate_series(1, length(w) - 1), lambda k: substring(w, k, 2)) ELSE [] END))) AS t FROM benchmark
"""
_ALIKE = f"""
WITH s AS ({_CLAIMS}), e AS (SELECT item_id, unnest(t) AS k FROM s), n AS (SELECT item_id, len(t) AS n FROM s),
p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS c FROM e x JOIN e y ON x.k = y.k AND x.item_id < y.item_id GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM p JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE c / (x.n + y.n - c) >= 0.2
"""


@query(_ALIKE)
def findings_like_pairs(spark, d):
    return findings.like_pairs(load(spark, d, "benchmark"), "item_id", "text", 0.2).withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH RECURSIVE pairs AS ({_ALIKE}), ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT item_id, item_id AS other FROM benchmark UNION SELECT r.item_id, b.b FROM reach r JOIN ways b ON b.a = r.other)
SELECT item_id, min(other) AS cluster FROM reach GROUP BY 1
""")
def findings_clusters(spark, d):
    return findings.cluster_claims(load(spark, d, "benchmark"), "item_id", "text", 0.2)


@query()
def findings_parse(spark, d):
    pages = load(spark, d, "pages").select("page_id", "url", tx.strip_tags(F.col("html")).alias("said"))
    pages = pages.select("page_id", F.concat(F.lit("## github release\n- "), F.col("said"), F.lit(" "), F.col("url"), F.lit("\n- "), F.col("said"), F.lit(" (https://www.other.org/x)\n")).alias("md"))
    found = findings.parse(pages, "page_id", "md")
    return found.select("page_id", "line", "heading", "channel", "claim", F.array_join("urls", " ").alias("urls"), F.array_join("hosts", " ").alias("hosts"))


@query("SELECT source AS cluster, count(*) AS size, count(DISTINCT lang) AS hosts, count(DISTINCT lang) >= 2 AS verified FROM documents GROUP BY 1")
def findings_corroborated(spark, d):
    return findings.corroborated(load(spark, d, "documents").withColumnRenamed("source", "cluster"), "cluster", "lang")
