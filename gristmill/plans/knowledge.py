"""Queries over the knowledge base, findings, entries, and functions on cells and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import layout
from ..functions import text as tx
from ..functions import values as v
from ..operators import findings, graph, kb, listing, media, packs, store, tabular
from ..session import load
from ..sources import stores
from .search import _bm25_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- knowledge base -------------------------------------------------------------

#: Documents cut into chunks of 500 characters; some are lost, some were changed, some documents share their content with another.
_KB = """
src AS (SELECT doc_id, text, lang, 'dir/' || cast(doc_id AS varchar) || '.md' AS path, substring(sha1(chr(0) || text), 1, 12) AS hash FROM documents WHERE text <> ''),
man AS (SELECT 'kb:' || substring(sha1(chr(0) || path), 1, 12) AS doc_id, path, hash, cast(ceil(length(text) / 500.0) AS int) AS chunks, CASE lang WHEN 'en' THEN 'verified' WHEN 'de' THEN 'unverified' ELSE 'user' END AS tier,
 '2024-03-' || lpad(cast(1 + doc_id % 28 AS varchar), 2, '0') || 'T10:00:00Z' AS at FROM src),
allc AS (SELECT DISTINCT hash, n, substring(text, 1 + 500 * (n - 1), 500) AS text, 'part ' || cast(n AS varchar) AS outline FROM (SELECT hash, text, unnest(generate_series(1, cast(ceil(length(text) / 500.0) AS int))) AS n FROM src)),
chk AS (SELECT 'kb:' || hash || ':' || cast(n AS varchar) AS chunk_id, hash, n, text, outline FROM allc WHERE NOT (substring(hash, 1, 1) = '0' AND n = 1) AND NOT (substring(hash, 1, 1) = '1' AND n = 2)),
j AS (SELECT m.doc_id, path, tier, m."at", chunk_id, n, text, outline || ' · 来源 ' || path || ' · ' || substring(m."at", 1, 10) AS header FROM man m JOIN chk c ON m.hash = c.hash AND n <= chunks)
"""


def _kb(spark, d):
    docs = load(spark, d, "documents").filter("text <> ''").select("doc_id", "text", "lang", F.concat(F.lit("dir/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), tx.content_hash(F.col("text"), "").alias("hash"))
    n = F.ceil(F.length("text") / 500)
    at = F.concat(F.lit("2024-03-"), F.lpad((1 + F.col("doc_id") % 28).cast("string"), 2, "0"), F.lit("T10:00:00Z"))
    tier = F.when(F.col("lang") == "en", " Verified ").when(F.col("lang") == "de", "unverified").otherwise("odd")
    manifest = docs.select(kb.doc_id(F.col("path")).alias("id"), "path", "hash", F.lit("").alias("title"), F.length("text").cast("double").alias("bytes"), F.length("text").cast("double").alias("chars"), n.cast("double").alias("chunks"), tier.alias("tier"), at.alias("at"))
    manifest = manifest.unionByName(manifest.limit(1).withColumn("id", F.lit(" ")))  # a row without an id, which goes
    every = docs.select("hash", "text", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("n")).select("hash", "n", F.substring("text", 1 + 500 * (F.col("n") - 1), F.lit(500)).alias("text"))
    lost, changed = (F.substring("hash", 1, 1) == "0") & (F.col("n") == 1), (F.substring("hash", 1, 1) == "1") & (F.col("n") == 2)
    span = F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    chunks = every.filter(~lost).select(kb.chunk_id(F.col("hash"), F.col("n")).alias("id"), F.col("n").cast("double").alias("n"), F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), span.alias("span"), F.concat(F.lit("part "), F.col("n").cast("string")).alias("outline"), tx.content_hash(F.col("text"), "").alias("hash"))
    return kb.manifest_rows(manifest), kb.chunk_rows(chunks)


@query(f'WITH {_KB} SELECT doc_id, path, path AS title, hash, chunks, tier, "at" FROM man')
def kb_manifest(spark, d):
    return _kb(spark, d)[0].select(F.col("id").alias("doc_id"), "path", "title", "hash", "chunks", "tier", "at")


@query(f'WITH {_KB} SELECT doc_id, chunk_id, n, path, tier, "at", header, md5(text) AS text FROM j')
def kb_joined(spark, d):
    return kb.joined(*_kb(spark, d)).select("doc_id", "chunk_id", "n", "path", "tier", "at", "header", F.md5("text").alias("text"))


@query(f"WITH {_KB} SELECT m.doc_id, chunks, count(n) AS found, chunks - count(n) AS missing FROM man m LEFT JOIN j ON j.doc_id = m.doc_id GROUP BY 1, 2")
def kb_missing(spark, d):
    return kb.missing(*_kb(spark, d)).select("doc_id", "chunks", "found", F.col("missing").cast("long").alias("missing"))


@query(f"WITH {_KB} SELECT min(doc_id) AS doc_id, chunk_id FROM j WHERE tier = 'user' GROUP BY 2")
def kb_candidates_of_tier(spark, d):
    return kb.candidates(*_kb(spark, d), tier="user").select("doc_id", "chunk_id")


_ROUTES = (
    f"WITH {_KB}, c AS (SELECT chunk_id, min(doc_id) AS doc_id FROM j GROUP BY 1), cand AS (SELECT j.* FROM j JOIN c USING (chunk_id, doc_id)), " + _bm25_sql("cand", "chunk_id", "text", ["the", "que"])
    + ", " + _bm25_sql("cand", "chunk_id", "header", ["the", "que"], "2")
    + ", best AS (SELECT a.id AS chunk_id, round(0.75 * a.score / (SELECT max(score) FROM bm) + 0.25 * CASE WHEN (SELECT max(score) FROM bm2) > 0 THEN b.score / (SELECT max(score) FROM bm2) ELSE 0 END, 9) AS score FROM bm a JOIN bm2 b USING (id) WHERE a.score > 0 OR b.score > 0)"
)


@query(_ROUTES + " SELECT chunk_id, doc_id, path, round(score, 6) AS score, left(header, 20) AS header FROM best JOIN cand USING (chunk_id) ORDER BY best.score DESC, chunk_id LIMIT 8")
def kb_find(spark, d):
    return kb.find(*_kb(spark, d), "the que", 8)[0].select("chunk_id", "doc_id", "path", F.round("score", 6).alias("score"), F.substring("header", 1, 20).alias("header"))


@query(_ROUTES + """
SELECT 'hits' AS reason, (SELECT count(*) FROM man) AS docs, (SELECT count(*) FROM cand) AS chunks, (SELECT count(*) FROM best) AS matched, (SELECT sum(chunks) FROM man) - (SELECT count(*) FROM j) AS missing, (SELECT count(*) FROM best) > 8 AS truncated
UNION ALL SELECT 'no-overlap', (SELECT count(*) FROM man), (SELECT count(*) FROM cand), 0, (SELECT sum(chunks) FROM man) - (SELECT count(*) FROM j), false
UNION ALL SELECT 'filter-empty', 0, 0, 0, 0, false
""")
def kb_find_reasons(spark, d):
    manifest, chunks = _kb(spark, d)
    found = [kb.find(manifest, chunks, "the que", 8)[1], kb.find(manifest, chunks, "zzzabsentzzz", 8)[1], kb.find(manifest, chunks, "the", 8, path="nowhere")[1]]
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.select("reason", "docs", "chunks", "matched", F.col("missing").cast("long").alias("missing"), "truncated")


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Title of ' || cast(doc_id AS varchar) ELSE 'f' || cast(doc_id AS varchar) || '.md' END AS title, 'Outline · 来源 a.md · 2024-01-05' AS header, '来源 a.md' AS short FROM documents
""")
def kb_titles(spark, d):
    n = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## no\n  #  Title of "), n, F.lit("  \n"))).otherwise(F.lit("##  no\n#no\n"))
    one = F.lit("a.md")
    return load(spark, d, "documents").select("doc_id", kb.title(text, F.concat(F.lit("dir/f"), n, F.lit(".md"))).alias("title"), kb.header(F.lit(" Outline "), one, F.lit("2024-01-05T01:02:03Z")).alias("header"), kb.header(F.lit(""), one, F.lit(None)).alias("short"))


# --- findings --------------------------------------------------------------------

#: One markdown file for each benchmark item: a claim with two sites, one with one, one without, an empty one, a section that says nothing.
_TEXT = "left(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), 40)"


def _claims(spark, d):
    said = F.trim(F.regexp_replace(F.col("text"), r"[^A-Za-z0-9]+", " "))
    n = F.col("item_id").cast("string")
    parts = [
        F.lit("## 百科 wiki\n- "), said, F.lit(" https://www.one.org/"), n, F.lit("\n- "), said, F.lit(" (https://two.org/x)\n- 未找到。\n## GitHub release\n1. release "), n, F.lit(" came out https://one.org/y ,\n## 泛搜\n- none\n| - table\n## 社区讨论（platform: v2ex）\n* unsourced remark number "), n, F.lit("\n"),
    ]
    return load(spark, d, "benchmark").filter("text <> ''").select("item_id", F.concat(*parts).alias("md"))


_SAID = "trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))"


@query(f"""
SELECT item_id, 1 AS line, '百科' AS channel, {_SAID} AS claim, 'one.org two.org' AS hosts, 2 AS n_urls FROM benchmark WHERE text <> '' UNION ALL SELECT item_id, 5, '官方仓库', 'release ' || cast(item_id AS varchar) || ' came out', 'one.org', 1 FROM benchmark WHERE text <> ''
UNION ALL SELECT item_id, 10, '社交平台：社区', 'unsourced remark number ' || cast(item_id AS varchar), '', 0 FROM benchmark WHERE text <> ''
""")
def findings_claims(spark, d):
    found = findings.parse(_claims(spark, d), "item_id", "md")
    return found.select("item_id", "line", "channel", "claim", F.array_join(F.array_sort("hosts"), " ").alias("hosts"), F.size("urls").alias("n_urls"))


@query("SELECT item_id, 3 AS total, 2 AS single_source, 1 AS no_url, 1 AS corroborated, 2 AS unverified, 2 AS distinct_hosts, 'no_url,single_source,unverified,few_hosts' AS notes FROM benchmark WHERE text <> ''")
def findings_coverage(spark, d):
    out = findings.coverage(findings.clustered(findings.parse(_claims(spark, d), "item_id", "md"), "item_id"), "item_id")
    return out.withColumn("notes", F.array_join(findings.notes(), ","))


PLAN = [{"kind": "百科（入门）", "required": True}, {"kind": "官方仓库", "required": True}, {"kind": "社交平台", "platform": "V2EX"}, {"kind": "官方文档", "required": True}, {"kind": "权威媒体", "timeRange": "week", "required": True}, {"kind": "泛搜"}]


@query("SELECT item_id, '百科（入门）,官方仓库,社交平台（V2EX）' AS covered, '官方文档,权威媒体' AS missing, '泛搜' AS empty FROM benchmark WHERE text <> ''")
def findings_channels(spark, d):
    docs = _claims(spark, d)
    covered = findings.covered_channels(findings.parse(docs, "item_id", "md"), "item_id", PLAN)
    return covered.join(findings.empty_channels(docs, "item_id", "md"), "item_id", "left").select("item_id", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), F.array_join("channels", ",").alias("empty"))


@query(f"""
WITH b AS (SELECT item_id, item_id % 3 AS topic, {_SAID} AS said FROM benchmark WHERE text <> '')
SELECT topic, claim, count(DISTINCT host) AS n_hosts FROM (SELECT topic, said AS claim, unnest(['one.org', 'two.org']) AS host FROM b UNION ALL SELECT topic, 'release ' || cast(item_id AS varchar) || ' came out', 'one.org' FROM b UNION ALL SELECT topic, 'unsourced remark number ' || cast(item_id AS varchar), NULL FROM b) GROUP BY 1, 2
""")
def findings_merged(spark, d):
    found = findings.parse(_claims(spark, d), "item_id", "md").withColumn("topic", F.col("item_id") % 3)
    return findings.merge_files(found, "topic", "item_id").select("topic", "claim", F.size(F.array_distinct("hosts")).cast("long").alias("n_hosts"))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '百科' WHEN 1 THEN '官方仓库' WHEN 2 THEN '泛搜' WHEN 3 THEN '未分组' WHEN 4 THEN '知识问答' ELSE 'own heading' END AS channel, 'claim ' || cast(doc_id AS varchar) || ' holds' AS claim, 'plain <b> text & more' AS stripped FROM documents
""")
def fn_claims(spark, d):
    kind = F.col("doc_id") % 6
    heading = F.when(kind == 0, "My Wiki page").when(kind == 1, "GitHub releases").when(kind == 2, "初步 概览").when(kind == 3, "  ").when(kind == 4, "StackOverflow 回答").otherwise(" own heading ")
    claim = F.concat(F.lit("claim  "), F.col("doc_id").cast("string"), F.lit(" holds [see](https://a.org/x) (https://b.org/y ) https://c.org/z ，;（ ） "))
    html = F.lit("<p>plain</p>\n &lt;b&gt;<i> text</i>&#32;&amp; more<br/>")
    return load(spark, d, "documents").select("doc_id", findings.channel(heading).alias("channel"), findings.claim_text(claim).alias("claim"), tx.strip_tags(html).alias("stripped"))


# --- entries, links, volumes -------------------------------------------------------

def _entries(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.lit("normal").alias("importance"))


@query("SELECT cast(doc_id AS varchar) AS id, CASE WHEN doc_id = 7 THEN 'new words' ELSE text END AS content, CASE WHEN doc_id = 7 THEN 'critical' ELSE 'normal' END AS importance FROM documents UNION ALL SELECT 'm-1', 'added', 'low'")
def store_replace_and_add(spark, d):
    entries = store.replace_entry(_entries(spark, d), {"content": "new words", "importance": "critical"}, wanted="7")
    return store.add_entry(entries, {"id": "m-1", "content": "added", "importance": "low"}, 1000)


@query("SELECT cast(doc_id AS varchar) AS id, 'kept' AS what FROM documents WHERE doc_id <> 8 UNION ALL SELECT '8', 'remove' UNION ALL SELECT cast(doc_id AS varchar), 'edge' FROM documents WHERE doc_id <> 8 AND doc_id + 1 <> 8")
def store_remove_entry(spark, d):
    entries = _entries(spark, d)
    edges = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("src"), (F.col("doc_id") + 1).cast("string").alias("dst"))
    out = store.remove_entry(entries, edges, wanted="8")
    return out["entries"].select("id", F.lit("kept").alias("what")).unionByName(out["tombstone"].withColumnRenamed("reason", "what")).unionByName(out["edges"].select(F.col("src").alias("id"), F.lit("edge").alias("what")))


@query("""
SELECT event_id, CASE WHEN kind = 'critical' THEN t - coalesce(g, 0) > 400 ELSE t - coalesce(g, 0) > 200 END AS evicted FROM (SELECT *, sum(size) OVER (PARTITION BY user_id) AS t, sum(size) OVER (PARTITION BY user_id ORDER BY CASE kind WHEN 'low' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
 FROM (SELECT event_id, user_id, cast(trunc(value) AS bigint) AS size, CASE event_type WHEN 'click' THEN 'critical' WHEN 'view' THEN 'normal' ELSE 'low' END AS kind FROM events))
""")
def store_demote(spark, d):
    df = load(spark, d, "events").selectExpr("event_id", "user_id", "cast(floor(value) AS bigint) AS size", "CASE event_type WHEN 'click' THEN 'critical' WHEN 'view' THEN 'normal' ELSE 'low' END AS importance")
    return store.demote(df, ["user_id"], "event_id", "size", 200, 400).select("event_id", "evicted")


@query("SELECT event_id, volume, month FROM (SELECT event_id, cast(event_id % 4 AS int) AS volume, strftime(ts, '%Y-%m') AS month FROM events) WHERE (month, volume) IN (SELECT (month, volume) FROM (SELECT DISTINCT strftime(ts, '%Y-%m') AS month, cast(event_id % 4 AS int) AS volume FROM events) ORDER BY month DESC, volume DESC LIMIT 3)")
def store_keep_volumes(spark, d):
    df = load(spark, d, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("volume"), F.date_format("ts", "yyyy-MM").alias("month"))
    return store.keep_volumes(df, 3).select("event_id", "volume", "month")


@query("SELECT 'customer' AS origin, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def store_union_origins(spark, d):
    return stores.union_origins(customer=load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), supplier=load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).select("origin", "id", "name")


_LINKS = "SELECT n_regionkey AS src, n_nationkey AS dst, 'holds' AS kind, cast(NULL AS varchar) AS conflict_class, 'open' AS conflict_state FROM nation"
_MORE = "SELECT * FROM (SELECT c_nationkey % 5 AS src, c_nationkey AS dst, CASE WHEN c_nationkey % 2 = 0 THEN 'holds' ELSE 'serves' END AS kind, 'kind' AS conflict_class, 'closed' AS conflict_state FROM customer GROUP BY c_nationkey) WHERE src <> dst"


@query(f"""
SELECT l.src, l.dst, l.kind, coalesce(m.conflict_class, l.conflict_class) AS conflict_class, coalesce(m.conflict_state, l.conflict_state) AS conflict_state FROM ({_LINKS}) l LEFT JOIN ({_MORE}) m USING (src, dst, kind)
UNION ALL SELECT m.* FROM ({_MORE}) m LEFT JOIN ({_LINKS}) l USING (src, dst, kind) WHERE l.conflict_state IS NULL
""")
def store_upsert_links(spark, d):
    edges = load(spark, d, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"), F.lit("holds").alias("kind"), F.lit(None).cast("string").alias("conflict_class"), F.lit("open").alias("conflict_state"))
    key = F.col("c_nationkey")
    more = load(spark, d, "customer").select((key % 5).alias("src"), key.alias("dst"), F.when(key % 2 == 0, "holds").otherwise("serves").alias("kind"), F.lit("kind").alias("conflict_class"), F.lit("closed").alias("conflict_state"))
    return packs.upsert_links(edges, more)


@query("SELECT id, min(t) AS tier FROM (SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'verified' ELSE 'user' END AS tier, CASE WHEN lang = 'en' THEN 3 ELSE 2 END AS r FROM documents UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 'verified' ELSE 'unverified' END, CASE WHEN quality = 1 THEN 3 ELSE 1 END FROM labels) GROUP BY 1".replace("min(t)", "arg_min(tier, r)"))
def store_strictest_tiers(spark, d):
    known = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "verified").otherwise("user").alias("tier"))
    return packs.import_tiers(known, load(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "verified").otherwise("unverified").alias("tier")))


@query("""
WITH m AS (SELECT cast(doc_id AS varchar) AS id, md5(text) AS hash, n_chars % 4 AS chunks, doc_id FROM documents),
live AS (SELECT id FROM m WHERE doc_id % 3 <> 0 UNION SELECT 'kb:' || hash || ':' || cast(unnest(generate_series(1, chunks)) AS varchar) FROM m WHERE doc_id % 3 <> 0),
every AS (SELECT id FROM m UNION SELECT 'kb:' || hash || ':' || cast(unnest(generate_series(1, chunks)) AS varchar) FROM m)
SELECT id FROM every EXCEPT SELECT id FROM live
""")
def store_drop_documents(spark, d):
    manifest = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("hash"), (F.col("n_chars") % 4).alias("chunks"))
    gone = load(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"))
    edges = manifest.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("x").alias("kind"))
    return packs.drop_documents(manifest, gone, edges)["dead"]


@query("SELECT user_id, sha1(cast(to_json(list_sort(list({'a': event_id, 'b': event_type}))) AS varchar)) AS block FROM events GROUP BY 1")
def store_block_ids(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(store.block_id(F.collect_list(F.struct(F.col("event_id").alias("a"), F.col("event_type").alias("b")))).alias("block"))


@query("SELECT o_orderkey, c_name AS name, c_name IS NULL AS dangling FROM (SELECT o_orderkey, o_custkey + o_orderkey % 2 * 10000000 AS k FROM orders) LEFT JOIN customer ON k = c_custkey")
def graph_lookup(spark, d):
    refs = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 2 * 10000000).alias("id"))
    index = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return graph.looked_up(refs, index.unionByName(index), "id", "name").select("o_orderkey", "name", "dangling")


@query("""
WITH RECURSIVE l AS (SELECT conv_id, turn, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END, turn) AS r FROM conversations),
f AS (SELECT conv_id, turn, r, n <= 900 AS shown, CASE WHEN n <= 900 THEN n ELSE 0 END AS used FROM l WHERE r = 1
 UNION ALL SELECT l.conv_id, l.turn, l.r, f.used + l.n <= 900, CASE WHEN f.used + l.n <= 900 THEN f.used + l.n ELSE f.used END FROM f JOIN l ON l.conv_id = f.conv_id AND l.r = f.r + 1)
SELECT conv_id, turn, shown FROM f
""")
def store_shared_fill(spark, d):
    lines = load(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return store.shared_fill(lines, ["conv_id"], "role", ["user", "assistant"], "turn", "text", 900).select("conv_id", "turn", "shown")


def _pack(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "lang")
    begin = F.substring("content", 1, 9)

    def of(df, tier, k):
        next_, none = (F.col("doc_id") + 1).cast("string"), F.lit(None).cast("string")
        return {
            "tiers": df.select("id", F.lit(tier).alias("tier")), "entries": df.select("id", "content"), "ledger": df.select("id", "lang"), "tombstones": df.filter(F.col("doc_id") % k == 0).select("id"),
            "archive": df.select(F.col("lang").alias("block_id"), "id").dropDuplicates(["block_id"]), "documents": df.select("id"),
            "chunks": df.select(F.concat(F.lit("c"), "id").alias("id"), begin.alias("text"), F.when(F.col("doc_id") % 5 == 0, "bad").otherwise(tx.content_hash(begin, "")).alias("hash")),
            "links": df.select(F.col("id").alias("src"), next_.alias("dst"), F.lit("next").alias("kind"), none.alias("conflict_class"), F.lit("open").alias("conflict_state")),
        }

    return of(docs.filter("doc_id % 2 = 1"), "user", 7), of(docs.filter("doc_id % 3 = 0"), "verified", 9)


@query("""
WITH a AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 2 = 1), b AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 3 = 0), fresh AS (SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)),
dead AS (SELECT doc_id FROM a WHERE doc_id % 7 = 0), late AS (SELECT doc_id FROM dead UNION SELECT doc_id FROM b WHERE doc_id % 9 = 0)
SELECT 'tiers' AS store, (SELECT count(*) FROM fresh) AS added UNION ALL SELECT 'entries', (SELECT count(*) FROM fresh WHERE doc_id NOT IN (SELECT doc_id FROM dead) AND trim(text) NOT IN (SELECT trim(text) FROM a)) UNION ALL SELECT 'ledger', (SELECT count(*) FROM fresh)
UNION ALL SELECT 'tombstones', (SELECT count(*) FROM late) - (SELECT count(*) FROM dead) UNION ALL SELECT 'archive', (SELECT count(DISTINCT lang) FROM b WHERE lang NOT IN (SELECT lang FROM a)) UNION ALL SELECT 'documents', (SELECT count(*) FROM fresh)
UNION ALL SELECT 'chunks', (SELECT count(*) FROM fresh WHERE doc_id % 5 <> 0) UNION ALL SELECT 'links', (SELECT count(*) FROM fresh WHERE doc_id NOT IN (SELECT doc_id FROM late) AND doc_id + 1 NOT IN (SELECT doc_id FROM late))
""")
def store_import_pack(spark, d):
    known, pack = _pack(spark, d)
    return packs.import_pack(known, pack)[1]


@query("""
SELECT 'nation' AS store, count(*) AS rows, cast(sum(octet_length(encode(n_name))) AS bigint) AS bytes FROM nation UNION ALL SELECT 'dangling', (SELECT count(*) FROM nation WHERE n_regionkey = 2), 0 UNION ALL SELECT 'tombstones', (SELECT count(*) FROM customer WHERE c_acctbal < 0), 0
""")
def list_status_report(spark, d):
    nation = load(spark, d, "nation")
    edges = nation.select((F.col("n_regionkey") + 1000).alias("src"), F.col("n_nationkey").alias("dst"), F.lit("in").alias("kind"))
    live = nation.select(F.col("n_nationkey").alias("node")).unionByName(load(spark, d, "region").filter("r_regionkey <> 2").select((F.col("r_regionkey") + 1000).alias("node")))
    return listing.status_report({"nation": nation}, "n_name", edges, live, load(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id")))


# --- listings ------------------------------------------------------------------------

@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(value % 3) DESC, ts DESC, event_id) AS place FROM events")
def list_by_score(spark, d):
    df = load(spark, d, "events").select("user_id", "event_id", F.floor(F.col("value") % 3).alias("score"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))
    return df.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*listing.by_score())).cast("long").alias("place"))


@query("SELECT n_name AS root FROM nation ORDER BY n_nationkey % 7 = 8 DESC, n_nationkey % 2 = 0 DESC, n_nationkey % 5 DESC, n_regionkey DESC, n_nationkey LIMIT 1")
def list_best_root(spark, d):
    key = F.col("n_nationkey")
    rows = load(spark, d, "nation").select(F.col("n_name").alias("root"), F.when(key % 7 == 3, F.lit(None)).otherwise(key % 7 == 8).alias("recent"), (key % 2 == 0).alias("has_memory"), (key % 5).alias("at"), F.col("n_regionkey").alias("mtime"), key.alias("ord"))
    return listing.best_root(rows)


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'word' ELSE 'excel+word' END AS key, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'page,table' ELSE 'cell,table,page' END AS terms FROM documents")
def list_signal_terms(spark, d):
    terms = {"word": ["page", "table"], "excel": ["cell", "table"]}
    kind = F.col("doc_id") % 3
    topic, script = F.when(kind == 1, "word").otherwise(F.lit(None)), F.when(kind == 2, "await Office.word.x(); office.excel.y(); office.files.z()").otherwise("none")
    found = listing.signal_terms(topic, script, terms)
    return load(spark, d, "documents").select("doc_id", found["key"].alias("key"), F.array_join(found["terms"], ",").alias("terms"))


@query("SELECT p_partkey, array_to_string(list_slice(list_concat(string_split(p_name, ' '), ['', '', '', '']), 1, 3), '|') AS cells FROM part")
def table_fit_width(spark, d):
    return load(spark, d, "part").select("p_partkey", F.array_join(tabular.fit_width(F.split("p_name", " "), 3), "|").alias("cells"))


@query("""
SELECT conv_id, turn FROM (SELECT conv_id, turn, e, s, max(e) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM (SELECT conv_id, turn, turn * 10.0 AS s, turn * 10 + 2.0 + turn % 4 * 3 AS e, turn * 10 + 10.0 AS o FROM conversations) WHERE e <= o) WHERE said IS NULL OR s >= said
""")
def media_owned(spark, d):
    turn = F.col("turn")
    df = load(spark, d, "conversations").select("conv_id", "turn", (turn * 10.0).alias("s"), (turn * 10 + 2.0 + turn % 4 * 3).alias("e"), (turn * 10 + 10.0).alias("o"))
    return media.owned_segments(df, "conv_id", "turn", "s", "e", "o", F.lit(False)).select("conv_id", "turn")


@query("""
SELECT event_id, coalesce(sum(CASE WHEN event_type = 'view' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3 AS allowed FROM events
""")
def media_quota_with_refunds(spark, d):
    return media.quota_used(load(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "view", 3).select("event_id", "allowed")


# --- functions on cells and texts ---------------------------------------------------------

@query("""
SELECT event_id, CASE k WHEN 0 THEN 'number' WHEN 1 THEN 'number' WHEN 2 THEN 'number' WHEN 3 THEN 'date' ELSE 'text' END AS kind, CASE k WHEN 0 THEN event_id WHEN 1 THEN event_id / 100.0 WHEN 2 THEN event_id WHEN 3 THEN 45292 + event_id % 28 END AS number,
 CASE k WHEN 4 THEN 'word ' || cast(event_id AS varchar) WHEN 5 THEN '' END AS text, k = 2 AS money, k = 1 AS percent FROM (SELECT event_id, event_id % 6 AS k FROM events)
""")
def values_compiled(spark, d):
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 6
    raw = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("%"))).when(k == 2, F.concat(F.lit("¥"), n)).when(k == 3, F.concat(F.lit("2024-1-"), (1 + F.col("event_id") % 28).cast("string"))).when(k == 4, F.concat(F.lit("word "), n))
    made = v.compiled(raw)
    return load(spark, d, "events").select("event_id", *(made[c].alias(c) for c in ("kind", "number", "text", "money", "percent")))


@query("""
SELECT event_id, CASE WHEN n > 40 THEN '{"n":' || cast(event_id AS varchar) || ',"t":"' || event_type || '","x":"Infinity","l":[' || array_to_string(generate_series(1, 40), ',') || ',"…共 ' || cast(n AS varchar) || ' 项"],"d":{"a":{"b":{"c":"[深度截断]"}}},"z":null}'
 ELSE '{"n":' || cast(event_id AS varchar) || ',"t":"' || event_type || '","x":"Infinity","l":[' || array_to_string(generate_series(1, n), ',') || '],"d":{"a":{"b":{"c":"[深度截断]"}}},"z":null}' END AS json FROM (SELECT event_id, event_type, 1 + event_id % 60 AS n FROM events)
""")
def values_safe_json(spark, d):
    deep = F.struct(F.struct(F.struct(F.struct(F.lit(1).alias("x")).alias("c")).alias("b")).alias("a"))
    row = F.struct(F.col("event_id").alias("n"), F.col("event_type").alias("t"), F.lit(float("inf")).alias("x"), F.sequence(F.lit(1), (1 + F.col("event_id") % 60).cast("int")).alias("l"), deep.alias("d"), F.lit(None).cast("string").alias("z"))
    df = load(spark, d, "events").select("event_id", row.alias("v"))
    return df.select("event_id", v.safe_json(F.col("v"), df.schema["v"].dataType).alias("json"))


_V6 = ["::1", "::", "fe80::1", "fd00::%x", "ff02::1", "2001:db8::%x", "2606:4700::%x", "2a00:1450:4001:81b::200e", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::808:808", "1:2:3:4:5:6:7", "g::1", "1::2::3", "1:2:3:4:5:6:7:8", "2002::1", "[2a00::1]"]
_V6_GOOD = {0: False, 1: False, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True, 8: False, 9: True, 10: False, 14: True, 15: False, 16: True}


@query("SELECT c_custkey, CASE c_custkey % 17 " + " ".join(f"WHEN {k} THEN {str(x).lower()}" for k, x in _V6_GOOD.items()) + " END AS public FROM customer")
def values_public_ipv6(spark, d):
    forms = F.array(*(F.lit(x.replace("%x", "a")) for x in _V6))
    return load(spark, d, "customer").select("c_custkey", v.public_ipv6(F.get(forms, (F.col("c_custkey") % 17).cast("int"))).alias("public"))


@query("""
SELECT event_id, k IN (0, 1, 5) AS is_date, CASE k WHEN 3 THEN '[1, 2]' END AS x, CASE event_id % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a,b c' ELSE '' END AS list, CASE event_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'text' WHEN 2 THEN 'text' WHEN 3 THEN NULL ELSE 'html' END AS class FROM (SELECT event_id, event_id % 6 AS k FROM events)
""".replace(" CASE k WHEN 3 THEN '[1, 2]' END AS x,", ""))
def values_formats(spark, d):
    pick = lambda n, *xs: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % n).cast("int"))
    code = pick(6, "yyyy-mm-dd", "[Red]hh:mm", "0.00", '#,##0"d"', "0\\d", "m/d")
    listed = pick(3, '["a","b"]', " a ,b c,", " , ")
    mime = pick(5, "Text/HTML; charset=x", "application/json", "image/svg+xml", "application/pdf", "application/xhtml+xml")
    return load(spark, d, "events").select("event_id", v.is_date_format(code).alias("is_date"), F.array_join(tx.parse_list(listed), ",").alias("list"), v.content_class(mime).alias("class"))


@query("""
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN printf('%.2f', x) WHEN 1 THEN format('{:,.2f}', x) WHEN 2 THEN regexp_replace(printf('%.2f', x * 100), '\\.?0+$', '') || '%' WHEN 3 THEN format('{:,d}', cast(floor(x) AS bigint)) WHEN 4 THEN '2000-00-00' ELSE cast(cast(floor(x) AS bigint) AS varchar) END AS shown
FROM (SELECT l_orderkey, l_linenumber, l_quantity * 64 + 0.25 AS x, l_orderkey % 6 AS k FROM lineitem)
""")
def values_display(spark, d):
    k = F.col("l_orderkey") % 6
    x = F.col("l_quantity") * 64 + 0.25
    number = F.when(k.isin(3, 5), F.floor(x).cast("double")).otherwise(x)
    code = F.get(F.array(*map(F.lit, ["0.00", "#,##0.00", "0%", "#,##0", "yyyy-mm-dd", "0"])), k.cast("int"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", layout.display_number(number, code).alias("shown"))


# --- provider payloads ------------------------------------------------------------------------

_FORMS = {
    "tavily": '{"results":[{"url":"<at>","title":"T","content":"S"},{"title":"no address"},{"url":"<at>","title":"again"}]}', "brave": '{"web":{"results":[{"url":"<at>","title":"T","description":"S","age":"D"}]}}',
    "bocha": '{"data":{"webPages":{"value":[{"siteUrl":"<at>","name":"T","summary":"S","dateLastCrawled":"D"}]}}}', "exa": '{"results":[{"url":"<at>","title":"T","highlights":["S"],"publishedDate":"D"}]}',
    "serper": '{"organic":[{"link":"<at>","title":"T","snippet":"S","date":"D"}]}', "searxng": '{"results":[{"url":"<at>","title":"T","content":"S","publishedDate":"D"}]}', "openai": '{"choices":[{"message":{"content":"see [T](<at>) ok"}}]}',
    "anthropic": '{"content":[{"type":"text","citations":[{"url":"<at>","cited_text":"S"}]},{"type":"web_search_tool_result","content":[{"type":"web_search_result","url":"<at>","title":"T","page_age":"D"}]}]}',
}


@query("SELECT page_id, family, url, 'T' AS title, CASE WHEN family <> 'openai' THEN 'S' END AS snippet, CASE WHEN family NOT IN ('tavily', 'openai') THEN 'D' END AS published_at FROM pages, (SELECT unnest(" + str(sorted(_FORMS)) + ") AS family)")
def source_providers(spark, d):
    pages, out = load(spark, d, "pages"), None
    for family, form in sorted(_FORMS.items()):
        rows = stores.provider_sources(pages.select("page_id", F.replace(F.lit(form), F.lit("<at>"), F.col("url")).alias("payload")), "page_id", "payload", family).withColumn("family", F.lit(family))
        out = rows if out is None else out.unionByName(rows)
    return out.select("page_id", "family", "url", "title", "snippet", "published_at")


@query("SELECT page_id, 0 AS ord, url, 'first & title' AS title, 'one' AS snippet FROM pages UNION ALL SELECT page_id, 1, 'https://b.org/' || cast(page_id AS varchar), 'second', NULL FROM pages")
def source_result_links(spark, d):
    a = '<a rel="x" class="big result__a" href="//redirect.example/l/?uddg={}&amp;z=1"><b>first</b> &amp; title</a><a class="result__snippet" href="y">one</a>'
    b = '<a class="result__a" href="//b.org/{}">second</a>'
    head, tail = a.split("{}"), b.split("{}")
    html = F.concat(F.lit(head[0]), F.url_encode("url"), F.lit(head[1]), F.lit(tail[0]), F.col("page_id").cast("string"), F.lit(tail[1]))
    return stores.result_links(load(spark, d, "pages").select("page_id", html.alias("html")), "page_id", "html")


@query("""
SELECT doc_id, replace(CASE WHEN instr(text, 'a') > 0 THEN left(text, instr(text, 'a') - 1) || '[A]' || substr(text, instr(text, 'a') + 1) ELSE text END, 'the', 'THE') AS text,
 concat_ws(';', CASE WHEN instr(text, 'a') > 0 THEN 'a' END, CASE WHEN instr(text, 'the') > 0 THEN 'the ×' || cast((length(text) - length(replace(text, 'the', ''))) // 3 AS varchar) END) AS applied,
 concat_ws(';', CASE WHEN instr(text, 'a') = 0 THEN 'a' END, CASE WHEN instr(text, 'the') = 0 THEN 'the' END, '', 'zzz absent') AS missing, '<a>&lt;"' || cast(doc_id AS varchar) AS raw FROM documents
""")
def fn_edits(spark, d):
    made = tx.edited(F.col("text"), [{"find": "a", "replace": "[A]", "all": False}, {"find": "the", "replace": "THE"}, {"find": ""}, {"find": "zzz absent"}])
    df = load(spark, d, "documents").select("doc_id", made.alias("m"), tx.unescape_xml(F.concat(F.lit("&lt;a&gt;&amp;lt;&quot;"), F.col("doc_id").cast("string"))).alias("raw"))
    return df.select("doc_id", "m.text", F.array_join("m.applied", ";").alias("applied"), F.array_join("m.missing", ";").alias("missing"), "raw")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'one two|three 数|据库' ELSE '|wide' END AS lines FROM part")
def layout_wrapped(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, "one two three 数据库").otherwise("\nwide   ")
    return load(spark, d, "part").select("p_partkey", F.array_join(layout.wrapped(text, 45.0, 11.0), "|").alias("lines"))


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gb18030' END AS charset, page_id % 4 = 2 OR (page_id % 4 = 3 AND page_id % 3 = 0) AS pdf FROM pages
""")
def values_content_types(spark, d):
    k = F.col("page_id")
    mime = F.when(k % 4 == 0, 'text/html; Charset="UTF-8"').when(k % 4 == 1, "text/html;charset= gb18030 ; x=1").when(k % 4 == 2, "Application/PDF; x").otherwise("application/octet-stream")
    url = F.when(k % 3 == 0, "https://a.org/b/C.PDF?x=1").otherwise("https://a.org/b?f=c.pdf")
    return load(spark, d, "pages").select("page_id", v.charset(mime).alias("charset"), v.looks_like_pdf(mime, url).alias("pdf"))


_RUN_SITES = "(SELECT lower(replace(n_name, ' ', '-')) || '.org' AS domain, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation)"


@query(f"""
WITH q AS (SELECT item_id, item_id % 5 AS topic, 'q' || cast(item_id AS varchar) AS query FROM benchmark), s AS (SELECT topic, item_id, 'site:' || domain || ' ' || query AS query FROM q JOIN {_RUN_SITES} ON item_id % 25 = k)
SELECT topic, item_id, query, 'https://r.org/' || query AS url, true AS scoped FROM s WHERE topic < 3 AND item_id % 2 = 0
UNION ALL SELECT topic, item_id, query, 'https://r.org/' || query, false FROM q WHERE topic NOT IN (SELECT topic FROM s WHERE topic < 3 AND item_id % 2 = 0)
""")
def list_search_run(spark, d):
    queries = load(spark, d, "benchmark").select("item_id", (F.col("item_id") % 5).alias("topic"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query"))
    sites = load(spark, d, "nation").select(F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".org")).alias("domain"), F.col("n_nationkey").alias("ordinal"))
    answered = listing.assign_sites(queries.filter("topic < 3 AND item_id % 2 = 0"), "item_id", sites).select("query")
    results = answered.unionByName(queries.select("query")).select("query", F.concat(F.lit("https://r.org/"), "query").alias("url"))
    return listing.search_run(queries, "item_id", "topic", sites, results)
