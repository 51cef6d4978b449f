"""Queries over listings, selections and documents that come and go."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import layout
from ..operators import listing, packs
from ..session import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW = dt.datetime(2024, 1, 31)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_IMPORTANCE = "CASE event_type WHEN 'click' THEN 'critical' WHEN 'view' THEN 'normal' ELSE 'low' END"


@query(f"""
SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY CASE {_IMPORTANCE} WHEN 'critical' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END, ts DESC, event_id) AS place FROM events
""")
def list_hot_order(spark, d):
    from pyspark.sql import Window

    df = load(spark, d, "events").selectExpr("user_id", "event_id AS id", "ts AS updated_at", f"{_IMPORTANCE} AS importance")
    return df.select("user_id", "id", F.row_number().over(Window.partitionBy("user_id").orderBy(*listing.hot_order(NOW))).cast("long").alias("place"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def list_latest(spark, d):
    return listing.latest(load(spark, d, "events"), "ts", "event_id").select("event_id", "ts")


@query("SELECT event_type, user_id, max(ts) AS at, count(*) AS items FROM events GROUP BY 1, 2 ORDER BY max(ts) DESC, user_id, event_type LIMIT 20")
def list_recent_blocks(spark, d):
    return listing.recent_blocks(load(spark, d, "events"), "event_type", "user_id", "ts")


@query("""
SELECT 'orders' AS layer, o_orderkey AS id, o_orderdate AS at, place FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 30
UNION ALL SELECT 'events', event_id, ts, place FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events) WHERE place <= 10
""")
def list_browse(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    events = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return listing.browse({"orders": (orders, 30), "events": (events, 10)}, "at", "id").withColumn("place", F.col("place").cast("long"))


def _sites(spark, d):
    return load(spark, d, "nation").select(F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".org")).alias("domain"), F.col("n_nationkey").alias("ordinal"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("type"), (F.col("n_nationkey") % 3 != 0).alias("enabled"))


_SITES = "(SELECT lower(replace(n_name, ' ', '-')) || '.org' AS domain, n_nationkey AS ordinal, 'r' || n_regionkey AS type, n_nationkey % 3 <> 0 AS enabled FROM nation)"


@query(f"SELECT domain, ordinal FROM {_SITES} WHERE enabled AND type = 'r1'")
def list_sites_of_type(spark, d):
    return listing.select_sites(_sites(spark, d), "r1").select("domain", "ordinal")


@query(f"SELECT type, string_agg(domain, ',' ORDER BY ordinal) AS domains FROM {_SITES} GROUP BY 1")
def list_grouped_sites(spark, d):
    return listing.grouped_sites(_sites(spark, d), [f"r{k}" for k in range(5)]).select("type", F.array_join("domains", ",").alias("domains"))


@query(f"""
WITH s AS (SELECT domain, row_number() OVER (ORDER BY ordinal) - 1 AS k, count(*) OVER () AS n FROM {_SITES} WHERE enabled)
SELECT item_id, 'site:' || domain || ' ' || text AS query FROM benchmark JOIN s ON item_id % n = k
""")
def list_assigned_sites(spark, d):
    queries = load(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    return listing.assign_sites(queries, "item_id", _sites(spark, d).filter("enabled")).select("item_id", "query")


@query("SELECT page_id, row_number() OVER (ORDER BY page_id % 3 <> 0, page_id) AS place FROM pages")
def list_hits_first(spark, d):
    df = load(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "hit").alias("hit"))
    return listing.listed_first(df, "hit", "page_id").select("page_id", F.col("place").cast("long").alias("place"))


@query("""
SELECT doc_id, CASE WHEN contains(text, 'the ') AND NOT contains(text, ' que ') AND NOT contains(text, ' und ') THEN 'en' WHEN contains(text, ' que ') AND NOT contains(text, 'the ') AND NOT contains(text, ' und ') THEN 'fr'
 WHEN contains(text, ' und ') AND NOT contains(text, 'the ') AND NOT contains(text, ' que ') THEN 'de' ELSE 'mixed' END AS type, 'about ' || trim(text, ' ') || ';' || 'x' AS queries FROM documents
""")
def list_content_type(spark, d):
    kinds = {"en": ["the "], "fr": [" que "], "de": [" und "]}
    queries = listing.materialised(F.array(*map(F.lit, ["about {topic}", "x", " x ", ""])), F.col("text"))
    return load(spark, d, "documents").select("doc_id", listing.content_type(F.col("text"), kinds).alias("type"), F.array_join(queries, ";").alias("queries"))


@query("SELECT count(*) AS docs, cast(sum(n_chars % 7) AS bigint) AS chunks, cast(sum(octet_length(encode(text))) AS bigint) AS bytes, 0 AS unverified, count(*) FILTER (WHERE lang = 'en') AS user, count(*) FILTER (WHERE lang <> 'en') AS verified FROM documents")
def list_tier_counts(spark, d):
    df = load(spark, d, "documents").select((F.col("n_chars") % 7).alias("chunks"), F.octet_length("text").cast("long").alias("bytes"), F.when(F.col("lang") == "en", "user").otherwise("verified").alias("tier"))
    return listing.tier_counts(df)


@query("SELECT 'documents' AS store, count(*) AS rows, cast(sum(octet_length(encode(text))) AS bigint) AS bytes FROM documents UNION ALL SELECT 'benchmark', count(*), cast(sum(octet_length(encode(text))) AS bigint) FROM benchmark")
def list_status(spark, d):
    return listing.status({n: load(spark, d, n) for n in ("documents", "benchmark")}, "text")


_OLD = "(SELECT doc_id AS id, md5(text) AS hash, n_chars % 4 AS chunks, 'user' AS tier FROM documents WHERE doc_id % 5 <> 0)"
_NEW = "(SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE md5(text || 'x') END AS hash, n_chars % 4 AS chunks, CASE WHEN doc_id % 3 = 0 THEN 'verified' ELSE 'user' END AS tier FROM documents WHERE doc_id % 7 <> 0)"


def _manifests(spark, d):
    docs = load(spark, d, "documents")
    chunks = (F.col("n_chars") % 4).alias("chunks")
    old = docs.filter("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("hash"), chunks, F.lit("user").alias("tier"))
    hash_ = F.when(F.col("doc_id") % 2 == 0, F.md5("text")).otherwise(F.md5(F.concat("text", F.lit("x"))))
    new = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("id"), hash_.alias("hash"), chunks, F.when(F.col("doc_id") % 3 == 0, "verified").otherwise("user").alias("tier"))
    return old, new


@query(f"""
SELECT cast(coalesce(o.id, n.id) AS varchar) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN o.hash = n.hash AND o.tier <> n.tier THEN 'retiered' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'replaced' END AS action
FROM {_OLD} o FULL JOIN {_NEW} n ON o.id = n.id WHERE n.id IS NOT NULL
""")
def store_ingest(spark, d):
    return packs.ingest(*_manifests(spark, d))["report"]


_LIVE = "SELECT cast(id AS varchar) AS id FROM {t} UNION SELECT 'kb:' || hash || ':' || unnest(generate_series(1, chunks)) FROM {t} WHERE chunks > 0"
_KEPT = f"(SELECT coalesce(n.id, o.id) AS id, coalesce(n.hash, o.hash) AS hash, CASE WHEN n.id IS NULL THEN o.chunks ELSE n.chunks END AS chunks FROM {_OLD} o FULL JOIN {_NEW} n ON o.id = n.id)"


@query(f"({_LIVE.format(t=_OLD)}) EXCEPT ({_LIVE.format(t=_KEPT)})")
def store_dead_chunks(spark, d):
    return packs.ingest(*_manifests(spark, d))["dead"]


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'dead' WHEN doc_id % 2 = 0 THEN 'known' WHEN trim(text) IN (SELECT trim(text) FROM documents WHERE doc_id % 2 = 0) THEN 'same content' ELSE 'added' END AS reason FROM documents) GROUP BY 1
""")
def store_import(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return packs.import_entries(docs.filter("id % 2 = 0"), docs, docs.filter("id % 11 = 0"))["report"]


_COUNT = "len(regexp_extract_all(text, '{}'))"
_NARROW = layout.NARROW.replace("'", "''")
_EM = f"{_COUNT.format(layout.FULL)} * 0.46 + {_COUNT.format(chr(92) + 't')} * 0.56 - {_COUNT.format(_NARROW)} * 0.26 + {_COUNT.format(layout.WIDE)} * 0.36 + {_COUNT.format('[A-HJ-LN-VX-Z]')} * 0.12 + {_COUNT.format('[0-9]')} * 0.02 - {_COUNT.format(chr(92) + 'n')} * 0.54 + length(text) * 0.54"


@query(f"""
SELECT doc_id, round({_EM}, 4) AS em, cast(length(text) + {_COUNT.format(layout.FULL + '|' + chr(92) + 't')} AS int) AS width,
 replace(replace(regexp_replace(replace(text, chr(92), chr(92) || 'textbackslash{{}}'), '([&%$#_{{}}])', '\\\\\\1', 'g'), '~', chr(92) || 'textasciitilde{{}}'), '^', chr(92) || 'textasciicircum{{}}') AS latex FROM documents
""")
def layout_text(spark, d):
    return load(spark, d, "documents").select("doc_id", F.round(layout.estimate_em(F.col("text")), 4).alias("em"), layout.visual_width(F.col("text")).alias("width"), layout.escape_latex(F.col("text")).alias("latex"))
