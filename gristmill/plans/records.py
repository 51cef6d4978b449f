"""Queries over records: recall, stores, links, media plans, quotas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import graph, media, recall, store
from ..session import load, spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW = dt.datetime(2024, 1, 20, 12, 0, 0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _events(spark, d):
    return load(spark, d, "events")


@query("""
SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-14 23:59:59.999') AS inside, count(*) FILTER (WHERE ts IS NOT NULL AND NOT (ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-14 23:59:59.999')) AS outside,
 count(*) FILTER (WHERE ts IS NULL) AS unstamped FROM (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS ts FROM events)
""")
def recall_window_counts(spark, d):
    since, until = recall.resolve_window("last week", "last week", NOW)
    df = _events(spark, d).withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return recall.window_counts(df, "ts", since, until)


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def recall_window_rows(spark, d):
    since, until = recall.resolve_window("last 4 days", "now", NOW)
    return _events(spark, d).filter(recall.in_window(F.col("ts"), since, until)).select("event_id", "ts")


@query("SELECT event_id, round(pow(0.995, greatest(0, (epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 864e8)), 9) AS recency FROM events")
def recall_recency(spark, d):
    return _events(spark, d).select("event_id", F.round(recall.recency(F.col("ts"), NOW), 9).alias("recency"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value % 5 DESC, ts DESC, event_id) AS pool, floor(value % 5) / 4 AS rel FROM events),
t AS (SELECT *, CASE WHEN rel >= 0.6 THEN 'high' WHEN rel >= 0.25 THEN 'medium' ELSE 'unknown' END AS tier FROM r WHERE pool <= 40),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, tier ORDER BY pool) AS rk FROM t),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pool) AS place FROM k WHERE tier = 'high' OR rk <= CASE tier WHEN 'medium' THEN 6 ELSE 4 END)
SELECT user_id, event_id, tier, place FROM q WHERE place <= 8
""")
def recall_quality_tiers(spark, d):
    df = _events(spark, d).withColumn("score", F.floor(F.col("value") % 5))
    out = recall.quality_tiers(df, ["user_id"], [(F.col("value") % 5).desc(), F.col("ts").desc(), F.col("event_id")], "score", 4, 8)
    return out.select("user_id", "event_id", "tier", F.col("place").cast("long").alias("place"))


@query("""
WITH r AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS k FROM documents WHERE text <> ''),
u AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY ord) AS seen FROM r),
s AS (SELECT *, coalesce(sum(least(length(text), 300)) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, row_number() OVER (PARTITION BY source ORDER BY ord) AS place FROM u WHERE seen = 1)
SELECT source, doc_id, place, CASE WHEN length(text) > least(300, 4000 - used) THEN left(text, cast(least(300, 4000 - used) - 1 AS int)) || '…' ELSE text END AS admitted, length(text) > least(300, 4000 - used) AS truncated FROM s WHERE used < 4000 AND place <= 20
""")
def recall_admit(spark, d):
    out = recall.admit(spread(load(spark, d, "documents")), ["source"], [F.col("doc_id")], "text", 20, 300, 4000)
    return out.select("source", "doc_id", F.col("place").cast("long").alias("place"), "admitted", "truncated")


@query("SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE event_type END), ''), cast(user_id AS varchar)) AS stamp FROM events")
def recall_first_stamp(spark, d):
    df = _events(spark, d).select("event_id", F.when(F.col("event_id") % 2 == 0, " ").otherwise(F.col("event_type")).alias("a"), F.col("user_id").cast("string").alias("b"))
    return df.select("event_id", recall.first_stamp("a", "b").alias("stamp"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 5")
def store_rollover(spark, d):
    return store.newest(_events(spark, d), ["user_id"], [F.col("ts").desc(), F.col("event_id")], 5).select("user_id", "event_id")


@query("SELECT user_id, count(*) AS archived, min(event_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r > 5 GROUP BY 1")
def store_archived(spark, d):
    return store.newest(_events(spark, d), ["user_id"], [F.col("ts").desc(), F.col("event_id")], 5, keep=False).groupBy("user_id").agg(F.count("*").alias("archived"), F.min("event_id").alias("first"))


@query("""
WITH RECURSIVE b AS (SELECT month, day, items, row_number() OVER (PARTITION BY month ORDER BY day) AS r FROM (SELECT strftime(ts, '%Y-%m') AS month, cast(ts AS date) AS day, count(*) AS items FROM events GROUP BY 1, 2)),
v AS (SELECT month, day, items, r, 1 AS volume, items AS held FROM b WHERE r = 1
 UNION ALL SELECT b.month, b.day, b.items, b.r, CASE WHEN v.held > 0 AND v.held + b.items > 200 THEN v.volume + 1 ELSE v.volume END, CASE WHEN v.held > 0 AND v.held + b.items > 200 THEN b.items ELSE v.held + b.items END FROM v JOIN b ON b.month = v.month AND b.r = v.r + 1)
SELECT month, day, items, cast(volume AS int) AS volume FROM v
""")
def store_volumes(spark, d):
    blocks = _events(spark, d).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.to_date("ts").alias("day")).agg(F.count("*").alias("items"))
    return store.pack_volumes(blocks, "month", "day", "items")


@query("""
SELECT user_id, event_id, t - coalesce(g, 0) > 200 AS evicted FROM (SELECT user_id, event_id, sum(cast(value AS bigint)) OVER (PARTITION BY user_id) AS t,
 sum(cast(value AS bigint)) OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM (SELECT event_id, user_id, event_type, ts, trunc(value) AS value FROM events))
""")
def store_evict(spark, d):
    df = _events(spark, d).withColumn("size", F.floor("value").cast("long")).withColumn("at", F.struct("ts", "event_id"))
    return store.evict(df, ["user_id"], F.col("event_type"), "at", "size", 200).select("user_id", "event_id", "evicted")


@query("""
SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate, sum(1) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01')) WHERE n <= 1000
""")
def store_prune(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_orderdate", F.lit(1).alias("size"))
    return store.prune(df, "o_orderdate", "size", "o_orderkey", F.lit("1995-06-01").cast("timestamp"), 1000).select("o_orderkey", "o_orderdate")


@query("""
SELECT coalesce(l.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NOT NULL THEN c.quality ELSE l.quality END AS quality, CASE WHEN l.doc_id IS NULL THEN c.toxic ELSE l.toxic END AS toxic
FROM (SELECT DISTINCT * FROM labels) l FULL JOIN (SELECT doc_id, 1 - doc_id % 2 AS quality, 0 AS toxic FROM documents WHERE doc_id % 3 = 0) c ON l.doc_id = c.doc_id
""")
def store_upsert(spark, d):
    changes = load(spark, d, "documents").filter("doc_id % 3 = 0").select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return store.upsert(load(spark, d, "labels").distinct(), changes, ["doc_id"], ["quality"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def store_without_tombstones(spark, d):
    dead = load(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return store.without(load(spark, d, "orders").select("o_orderkey", "o_custkey"), dead, "o_custkey").select("o_orderkey")


@query("SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier")
def store_append_new(spark, d):
    return store.append_new(load(spark, d, "customer").select(F.col("c_custkey").alias("id")), load(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id")


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def store_dead_among(spark, d):
    live = [load(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), load(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))]
    return store.dead_among(load(spark, d, "orders").select(F.col("o_custkey").alias("id")), *live)


_PART = "sum(('0x' || substring(h, {a}, 12))::bigint)"


@query(f"""
SELECT sha1(concat_ws(':', count(*), {", ".join(_PART.format(a=1 + 12 * k) for k in range(3))})) AS fingerprint FROM (SELECT sha1(cast(to_json({{'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey}}) AS varchar)) AS h FROM customer)
""")
def store_fingerprint(spark, d):
    return store.fingerprint(load(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"])


@query("""
WITH RECURSIVE l AS (SELECT conv_id, turn, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (SELECT conv_id, turn, r, n <= 1500 AS shown, CASE WHEN n <= 1500 THEN n ELSE 0 END AS used FROM l WHERE r = 1
 UNION ALL SELECT l.conv_id, l.turn, l.r, f.used + l.n <= 1500, CASE WHEN f.used + l.n <= 1500 THEN f.used + l.n ELSE f.used END FROM f JOIN l ON l.conv_id = f.conv_id AND l.r = f.r + 1)
SELECT conv_id, turn, shown FROM f
""")
def store_greedy_fill(spark, d):
    return store.greedy_fill(load(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", 1500).select("conv_id", "turn", "shown")


@query("SELECT source, count(*) AS entries, cast(sum(octet_length(encode(text)) + 4) AS bigint) AS bytes FROM documents GROUP BY 1")
def store_usage(spark, d):
    return store.usage(load(spark, d, "documents"), "source", "text")


@query("SELECT name, mentions, refs FROM (SELECT event_type AS name, count(*) AS mentions, list_slice(list(event_id ORDER BY event_id), 1, 6) AS r, array_to_string(list_slice(list(event_id ORDER BY event_id), 1, 6), ',') AS refs FROM events GROUP BY 1) ORDER BY mentions DESC, name LIMIT 12")
def store_entities(spark, d):
    """The most mentioned names, each with its first six references."""
    return store.mentions(_events(spark, d), "event_type", "event_id").select("name", "mentions", F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"))


_EDGES = """
edges AS (SELECT 3000000 + s_nationkey AS src, 1000000 + s_suppkey AS dst, 'supplies' AS kind FROM supplier UNION ALL SELECT 4000000 + n_regionkey, 3000000 + n_nationkey, 'holds' FROM nation
 UNION ALL SELECT 3000000 + c_nationkey, 5000000 + c_custkey, 'serves' FROM customer),
live AS (SELECT 4000000 + r_regionkey AS node FROM region UNION ALL SELECT 3000000 + n_nationkey FROM nation UNION ALL SELECT 1000000 + s_suppkey FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 5000000 + c_custkey FROM customer)
"""


def _graph(spark, d):
    nation, supplier, customer, region = (load(spark, d, n) for n in ("nation", "supplier", "customer", "region"))
    at = lambda c, k: (F.col(c) + k).cast("long")
    edges = (
        supplier.select(at("s_nationkey", 3000000).alias("src"), at("s_suppkey", 1000000).alias("dst"), F.lit("supplies").alias("kind"))
        .unionByName(nation.select(at("n_regionkey", 4000000).alias("src"), at("n_nationkey", 3000000).alias("dst"), F.lit("holds").alias("kind")))
        .unionByName(customer.select(at("c_nationkey", 3000000).alias("src"), at("c_custkey", 5000000).alias("dst"), F.lit("serves").alias("kind")))
    )
    live = region.select(at("r_regionkey", 4000000).alias("node")).unionByName(nation.select(at("n_nationkey", 3000000).alias("node")))
    live = live.unionByName(supplier.filter("s_acctbal > 0").select(at("s_suppkey", 1000000).alias("node"))).unionByName(customer.select(at("c_custkey", 5000000).alias("node")))
    return edges, live


@query(f"""
WITH {_EDGES}, w AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
h0 AS (SELECT 4000000::bigint AS node), h1 AS (SELECT b AS node, min(a) AS via FROM w JOIN h0 ON a = node WHERE b NOT IN (SELECT node FROM h0) GROUP BY 1),
h2 AS (SELECT b AS node, min(a) AS via FROM w JOIN (SELECT node FROM h1 JOIN live USING (node)) ON a = node WHERE b NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1) GROUP BY 1),
h3 AS (SELECT b AS node, min(a) AS via FROM w JOIN (SELECT node FROM h2 JOIN live USING (node)) ON a = node WHERE b NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1 UNION SELECT node FROM h2) GROUP BY 1),
u AS (SELECT node, 0 AS hop, NULL::bigint AS via FROM h0 UNION ALL SELECT node, 1, via FROM h1 UNION ALL SELECT node, 2, via FROM h2 UNION ALL SELECT node, 3, via FROM h3)
SELECT node, hop, via, hop > 0 AND node NOT IN (SELECT node FROM live) AS dangling FROM u
""")
def graph_related(spark, d):
    edges, live = _graph(spark, d)
    return graph.related(edges, spark.createDataFrame([(4000000,)], "node long"), live)


_STEP = """
f{n} AS (SELECT b AS node, arg_min(a, p || lpad(cast(o AS varchar), 20, '0')) AS via, arg_min(kind, p || lpad(cast(o AS varchar), 20, '0')) AS kind, min(p || lpad(cast(o AS varchar), 20, '0')) AS p
 FROM w JOIN (SELECT node, p FROM f{m} WHERE node IN (SELECT node FROM live)) ON a = node WHERE b NOT IN ({seen}) GROUP BY 1)"""
_EXPANDED = ",".join(_STEP.format(n=n, m=n - 1, seen=" UNION ALL ".join(f"SELECT node FROM f{k}" for k in range(n))) for n in (1, 2, 3))


@query(f"""
WITH {_EDGES}, o AS (SELECT *, 9000000 - dst % 1000000 * 7 % 1000003 + src % 10 AS ord FROM edges), w AS (SELECT src AS a, dst AS b, kind, ord AS o FROM o WHERE src <> dst UNION ALL SELECT dst, src, kind, ord FROM o WHERE src <> dst),
f0 AS (SELECT 3000005::bigint AS node, NULL::bigint AS via, NULL AS kind, lpad('3000005', 20, '0') AS p), {_EXPANDED}
SELECT node, hop, via, kind, hop > 0 AND node NOT IN (SELECT node FROM live) AS dangling FROM (SELECT node, 0 AS hop, via, kind FROM f0 UNION ALL SELECT node, 1, via, kind FROM f1 UNION ALL SELECT node, 2, via, kind FROM f2 UNION ALL SELECT node, 3, via, kind FROM f3)
""")
def graph_expanded(spark, d):
    edges, live = _graph(spark, d)
    edges = edges.withColumn("ord", 9000000 - F.col("dst") % 1000000 * 7 % 1000003 + F.col("src") % 10)
    return graph.expanded(edges, spark.createDataFrame([(3000005,)], "node long"), live).drop("place")


@query(f"""
WITH {_EDGES} SELECT node, cast(count(*) FILTER (WHERE kind = 'supplies') AS bigint) AS supplies, count(*) FILTER (WHERE kind = 'holds') AS holds, count(*) FILTER (WHERE kind = 'serves') AS serves, count(*) AS total
FROM (SELECT src AS node, kind FROM edges UNION ALL SELECT dst, kind FROM edges WHERE src <> dst) GROUP BY 1
""")
def graph_neighbour_counts(spark, d):
    return graph.neighbour_counts(_graph(spark, d)[0], ["supplies", "holds", "serves"])


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE src NOT IN (SELECT node FROM live) OR dst NOT IN (SELECT node FROM live)")
def graph_dangling(spark, d):
    return graph.dangling(*_graph(spark, d)).select("src", "dst", "kind")


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE src % 1000000 NOT IN (3, 7) AND dst % 1000000 NOT IN (3, 7)")
def graph_pruned(spark, d):
    edges, _ = _graph(spark, d)
    dead = edges.select(F.explode(F.array("src", "dst")).alias("node")).filter(F.col("node") % 1000000 % 1000000 == 3).unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node")).filter(F.col("node") % 1000000 == 7))
    return graph.pruned(edges, dead)


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem LEFT JOIN (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'unverified' ELSE 'user' END AS tier FROM supplier) ON l_suppkey = s_suppkey WHERE tier IS NULL OR tier = 'unverified')
""")
def graph_trusted(spark, d):
    refs = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("refs"))
    rows = load(spark, d, "orders").select("o_orderkey").join(refs, "o_orderkey", "left")
    tiers = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, "unverified").otherwise("user").alias("tier"))
    return graph.trusted(rows, "o_orderkey", "refs", tiers).select("o_orderkey")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def graph_first_seen(spark, d):
    return graph.first_seen(_events(spark, d), ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("""
SELECT event_id, i AS index, round(i * 7.0, 3) AS start, round(least(i * 7 + 9.0, s), 3) AS "end", round(least(i * 7 + 7.0, s), 3) AS owned_end
FROM (SELECT event_id, s, unnest(generate_series(0, greatest(cast(ceil(s / 7) AS int), 1) - 1)) AS i FROM (SELECT event_id, value AS s FROM events WHERE value > 0))
""")
def media_plan_chunks(spark, d):
    out = media.plan_chunks(_events(spark, d), "event_id", "value", 7, 2)
    return out.select("event_id", F.col("index").cast("long").alias("index"), *(F.round(c, 3).alias(c) for c in ("start", "end", "owned_end")))


@query("SELECT event_id, array_to_string(list_transform(generate_series(0, cast(floor(value / 10) AS int)), lambda k: cast(k * 10 AS varchar)), ',') AS times FROM events")
def media_frame_times(spark, d):
    times = media.frame_times(F.col("value"), every=10)
    return _events(spark, d).select("event_id", F.array_join(F.transform(times, lambda t: t.cast("long").cast("string")), ",").alias("times"))


@query("""
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn_id FROM events
""")
def media_turns(spark, d):
    df = _events(spark, d).withColumn("o", F.struct("ts", "event_id"))
    return media.turn_of(df, "user_id", "o", F.col("event_type") == "click", "event_id").select("user_id", "event_id", "turn_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 3 AS allowed FROM events")
def media_quota(spark, d):
    return media.quota(_events(spark, d), ["user_id", "event_type"], "event_id", 3).select("event_id", "allowed")


@query("""
SELECT event_id, CASE WHEN (n - 1) % 12 = 0 THEN 'full' WHEN p <> event_type THEN 'partial' ELSE 'unchanged' END AS emit FROM (SELECT event_id, event_type, row_number() OVER w AS n, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
""")
def media_changes(spark, d):
    return media.changes(_events(spark, d), ["user_id"], "event_id", "event_type").select("event_id", "emit")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations WHERE text <> '' GROUP BY 1")
def media_transcript(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    return load(spark, d, "conversations").filter("text <> ''").groupBy("conv_id").agg(media.join_transcript(parts).alias("transcript"))
