"""Queries over the business tables: summaries, statistics, cell values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as v
from ..operators import tabular as t
from ..session import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""
SELECT l_returnflag AS key, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS sum, count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS average FROM lineitem GROUP BY 1
UNION ALL SELECT 'Total', count(*), round(sum(l_extendedprice), 2), count(l_extendedprice), round(avg(l_extendedprice), 4) FROM lineitem
""")
def agg_group_summary(spark, d):
    out = t.group_summary(load(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.select("key", "n_rows", F.round("sum", 2).alias("sum"), "count", F.round("average", 4).alias("average"))


@query("""
SELECT c_mktsegment, count(c_acctbal) AS count, count(*) AS counta, round(sum(c_acctbal), 2) AS sum, round(avg(c_acctbal), 4) AS average, round(median(c_acctbal), 4) AS median,
 max(c_acctbal) AS max, min(c_acctbal) AS min, round(stddev_samp(c_acctbal), 4) AS stdev, round(var_samp(c_acctbal), 2) AS var FROM customer GROUP BY 1
""")
def agg_column_stats(spark, d):
    out = t.column_stats(load(spark, d, "customer"), "c_acctbal", ["计数", "counta", "total", "mean", "median", "max", "min", "std", "variance"], ["c_mktsegment"], shown="c_name")
    digits = {"sum": 2, "average": 4, "median": 4, "stdev": 4, "var": 2}
    return out.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns))


@query("SELECT l_orderkey, round(product(1 + l_tax), 9) AS product FROM lineitem GROUP BY 1")
def agg_product(spark, d):
    df = load(spark, d, "lineitem").select("l_orderkey", (1 + F.col("l_tax")).alias("x"))
    return t.column_stats(df, "x", ["product"], ["l_orderkey"]).select("l_orderkey", F.round("product", 9).alias("product"))


@query("""
SELECT s_name, s_nationkey, s_acctbal FROM supplier
UNION ALL SELECT 'Total', NULL, round(sum(s_acctbal), 2) FROM supplier
""")
def agg_total_row(spark, d):
    out = t.with_total_row(load(spark, d, "supplier").select("s_name", "s_nationkey", "s_acctbal"), "s_name", ["s_acctbal"])
    return out.withColumn("s_acctbal", F.round("s_acctbal", 2))


@query("SELECT count(*) FILTER (WHERE trim(o_orderpriority) = '' OR o_orderpriority IS NULL) AS blank_keys FROM orders")
def agg_blank_keys(spark, d):
    return t.blank_keys(load(spark, d, "orders"), "o_orderpriority")


@query("""
SELECT o_orderpriority AS category, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS "O",
 round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS "P" FROM orders GROUP BY 1
""")
def chart_pivot(spark, d):
    out = t.pivot_series(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])
    return out.select("category", *(F.round(c, 2).alias(c) for c in "FOP"))


@query("""
SELECT s_nationkey AS series, count(DISTINCT s_acctbal > 0) AS have, (SELECT count(DISTINCT s_acctbal > 0) FROM supplier) AS n FROM supplier GROUP BY 1 HAVING have <> n
""")
def chart_uneven_series(spark, d):
    return t.uneven_series(load(spark, d, "supplier").withColumn("rich", F.col("s_acctbal") > 0), "rich", "s_nationkey")


_CELL = "CASE l_linenumber % 6 WHEN 0 THEN '$' || cast(l_orderkey AS varchar) || '.5' WHEN 1 THEN cast(l_orderkey AS varchar) || '%' WHEN 2 THEN ' 1,' || cast(l_partkey AS varchar) WHEN 3 THEN '2024-01-0' || cast(l_linenumber AS varchar) WHEN 4 THEN '-' || cast(l_suppkey AS varchar) || '.25' ELSE 'n/a ' || l_returnflag END"


def _cells(spark, d):
    return load(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", _CELL.replace("varchar", "string") + " AS cell")


@query(f"""
SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(trim(cell), '^-?[\\d,]+(\\.\\d+)?%$') THEN 'percent' WHEN regexp_matches(trim(cell), '^-?[\\d,]+(\\.\\d+)?$') THEN 'number'
 WHEN regexp_matches(trim(cell), '^-?[¥$€£]\\s?[\\d,]+(\\.\\d+)?$') THEN 'currency' WHEN regexp_matches(trim(cell), '^\\d{{4}}[-/年]\\d{{1,2}}([-/月]\\d{{1,2}}日?)?$') THEN 'date' ELSE 'text' END AS kind,
 CASE WHEN cell LIKE 'n/a%' THEN NULL WHEN cell LIKE '2024%' THEN 2024 WHEN cell LIKE '%\\%' ESCAPE '\\' THEN cast(replace(cell, '%', '') AS double) / 100 ELSE cast(replace(replace(trim(cell), '$', ''), ',', '') AS double) END AS number
FROM (SELECT l_orderkey, l_linenumber, {_CELL} AS cell FROM lineitem)
""")
def values_classify(spark, d):
    return _cells(spark, d).select("l_orderkey", "l_linenumber", v.classify(F.col("cell")).alias("kind"), v.to_number(F.col("cell")).alias("number"))


@query("""
SELECT o_orderkey, round(date_diff('day', DATE '1899-12-30', cast(o_orderdate AS date)) + (date_part('hour', o_orderdate) * 3600 + date_part('minute', o_orderdate) * 60 + floor(date_part('second', o_orderdate))) / 86400.0, 8) AS serial,
 strftime(o_orderdate, '%Y-%m') AS month FROM orders
""")
def values_date_serial(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.round(v.date_serial(F.col("o_orderdate")), 8).alias("serial"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("SELECT o_orderkey, cast(date_trunc('day', o_orderdate) AS timestamp) AS at FROM orders")
def values_parse_date(spark, d):
    text = F.date_format("o_orderdate", "yyyy年M月d日")
    return load(spark, d, "orders").select("o_orderkey", v.parse_date(text).alias("at"))


@query("SELECT l_orderkey, l_linenumber, cast(format('{:.11e}', l_extendedprice * (1 - l_discount) / 7) AS double) AS clean FROM lineitem")
def values_clean_number(spark, d):
    x = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.clean_number(x).alias("clean"))


@query("""
SELECT p_partkey, CASE WHEN n < 26 THEN chr(cast(n + 65 AS int)) WHEN n < 702 THEN chr(cast((n - 26) // 26 + 65 AS int)) || chr(cast((n - 26) % 26 + 65 AS int))
 ELSE chr(cast((n - 702) // 676 + 65 AS int)) || chr(cast((n - 702) // 26 % 26 + 65 AS int)) || chr(cast((n - 702) % 26 + 65 AS int)) END AS letters, n + 1 AS col_index FROM (SELECT p_partkey, p_partkey % 18278 AS n FROM part)
""")
def values_references(spark, d):
    letters = v.column_letters(F.col("p_partkey") % 18278 + 1)
    return load(spark, d, "part").select("p_partkey", letters.alias("letters"), v.column_index(letters).alias("col_index"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7 ELSE greatest(10, least(50, cast(trunc(value) AS bigint))) END AS bounded FROM events")
def values_bounded_int(spark, d):
    x = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("value").cast("string"))
    return load(spark, d, "events").select("event_id", v.bounded_int(x, 7, 10, 50).alias("bounded"))


_IP = "concat(cast(c_custkey % 256 AS {s}), '.', cast(c_custkey * 7 % 300 AS {s}), '.', cast(c_nationkey AS {s}), '.', cast(c_custkey % 11 AS {s}))"


@query(f"""
SELECT c_custkey, CASE WHEN b <= 255 THEN NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
 OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) END AS public
FROM (SELECT c_custkey, c_custkey % 256 AS a, c_custkey * 7 % 300 AS b, c_nationkey AS c FROM customer)
""")
def values_public_ipv4(spark, d):
    return load(spark, d, "customer").select("c_custkey", v.public_ipv4(F.expr(_IP.format(s="string"))).alias("public"))


@query("""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '^www\\.', '') AS host,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), ':[0-9]+$', ''), '^www\\.', '') AS domain,
 length(url) <= 2048 AND regexp_matches(url, '^https?://[^/?#@\\s]+([/?#]\\S*)?$') AS valid, 'site:' || regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^www\\.', '') || ' q' AS site_query,
 'ftp://***@h/' || cast(page_id AS varchar) AS masked FROM pages
""")
def values_urls(spark, d):
    url = F.col("url")
    return load(spark, d, "pages").select(
        "page_id", tx.host(url).alias("host"), tx.domain(url).alias("domain"), v.valid_url(url).alias("valid"), F.concat(F.lit("site:"), tx.host(url), F.lit(" q")).alias("site_query"),
        tx.mask_credentials(F.concat(F.lit("ftp://user:pw@h/"), F.col("page_id").cast("string"))).alias("masked"),
    )


@query("""
SELECT event_id, CASE WHEN s >= 3600 THEN cast(s // 3600 AS varchar) || ':' || lpad(cast(s % 3600 // 60 AS varchar), 2, '0') || ':' || lpad(cast(s % 60 AS varchar), 2, '0')
 ELSE lpad(cast(s // 60 AS varchar), 2, '0') || ':' || lpad(cast(s % 60 AS varchar), 2, '0') END AS clock FROM (SELECT event_id, cast(floor(greatest(value, 0) * 60) AS bigint) AS s FROM events)
""")
def values_clock(spark, d):
    return load(spark, d, "events").select("event_id", tx.clock(F.col("value") * 60).alias("clock"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, cast(json_extract(max(props), '$.k') AS int) AS k FROM events GROUP BY 1")
def values_lists(spark, d):
    df = load(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("types"), F.max("props").alias("props"))
    return df.select("user_id", F.size(tx.string_list(F.col("types"))).cast("long").alias("kinds"), F.get_json_object("props", "$.k").cast("int").alias("k"))
