"""Listings over records and sites: orders, selections, plans, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import domain
from ..scratch import Scratch
from .graph import dangling
from .recall import recency
from .search import TIERS

#: Importance from first to last.  (Fixed values.)
IMPORTANCE = ["critical", "normal", "low"]


def hot_order(now) -> list[Column]:
    """Importance, then recency, then the time of change, then id."""
    rank = F.array_position(F.array(*map(F.lit, IMPORTANCE)), F.col("importance"))
    return [rank, recency(F.col("updated_at"), now).desc(), F.col("updated_at").desc(), F.col("id")]


def by_score(ordinal: str = "ord") -> list[Column]:
    """Score, then time, both falling; equal rows keep their order."""
    return [F.col("score").desc(), F.col("at").desc(), F.col(ordinal)]


def latest(df: DataFrame, at: str, key: str, n: int = 20, hard: int = 20) -> DataFrame:
    """The newest rows; the limit is the listing's purpose."""
    return df.orderBy(F.col(at).desc(), F.col(key)).limit(max(1, min(n, hard)))


def recent_blocks(df: DataFrame, origin: str, block: str, at: str, n: int = 20) -> DataFrame:
    """(origin, block, at, items): the newest blocks by their newest item."""
    return df.groupBy(origin, block).agg(F.max(at).alias("at"), F.count("*").alias("items")).orderBy(F.col("at").desc(), block, origin).limit(n)


def browse(layers: dict[str, tuple[DataFrame, int]], at: str, key: str) -> DataFrame:
    """All layers, each cut to its own number of newest rows, newest first within; the limits are the listing's purpose."""
    out = None
    for name, (df, most) in layers.items():
        newest = df.orderBy(F.col(at).desc(), F.col(key)).limit(most).withColumn("layer", F.lit(name))
        part = newest.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy(F.col(at).desc(), F.col(key))))  # at most ``most`` rows
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def best_root(df: DataFrame) -> DataFrame:
    """One row: what was used last, else what has records, the latest activity, the latest change, the first listed."""
    order = F.struct(F.coalesce("recent", F.lit(False)), "has_memory", F.coalesce("at", F.lit(0)), F.coalesce("mtime", F.lit(0)), -F.col("ord"))
    return df.agg(F.max_by("root", order).alias("root"))


def select_sites(sites: DataFrame, asked: bool | str | list[str] | None = None, most: int | None = None) -> DataFrame:
    """Site entries by catalogue order: none (False), those named whatever their switch, those of a type, or all that are on."""
    if asked is False:
        return sites.limit(0)
    if isinstance(asked, list):
        names = sites.sparkSession.createDataFrame([(k, x) for k, x in enumerate(asked)], "wanted int, name string").select("wanted", domain(F.col("name")).alias("domain")).filter("domain <> ''")
        picked = sites.join(F.broadcast(names.groupBy("domain").agg(F.min("wanted").alias("wanted"))), "domain").orderBy("wanted").drop("wanted")  # as many rows as were asked for
    else:
        picked = sites.filter("enabled")
        if isinstance(asked, str) and asked.strip():
            picked = picked.filter(F.col("type") == asked.strip())
        picked = picked.orderBy("ordinal")
    return picked if most is None else picked.limit(max(1, min(8, most)))


def missing_sites(sites: DataFrame, asked: list[str]) -> list[str]:
    """Names asked for that no entry has."""
    known = sites.select("domain").distinct()
    names = sites.sparkSession.createDataFrame([(x,) for x in asked], "name string").select("name", domain(F.col("name")).alias("domain")).filter("domain <> ''")
    return [r["name"] for r in names.join(known, "domain", "left_anti").collect()]


def assign_sites(queries: DataFrame, ordinal: str, sites: DataFrame) -> DataFrame:
    """Query i gets site i mod n; the text is prefixed with it."""
    n = F.count("*").over(Window.partitionBy())
    numbered = sites.select("domain", (F.row_number().over(Window.orderBy("ordinal")) - 1).alias("_k"), n.alias("_n"))
    every = numbered.agg(F.max("_n").alias("_n"))
    return queries.crossJoin(F.broadcast(every)).withColumn("_k", F.pmod(F.col(ordinal), F.col("_n")).cast("int")).join(numbered.select("_k", "domain"), "_k").withColumn("query", F.concat(F.lit("site:"), "domain", F.lit(" "), "query")).drop("_k", "_n")


def search_run(queries: DataFrame, ordinal: str, topic: str, sites: DataFrame, results: DataFrame) -> DataFrame:
    """(topic, ordinal, query, url, scoped) of a run: each query with its site put before it and what a table of results(query, url) holds for that.

    A topic none of whose scoped queries has a result falls back to the queries as they were.
    """
    plain = queries.select(topic, ordinal, F.col("query").alias("_plain"), "query")
    scoped = assign_sites(plain, ordinal, sites).join(results, "query").select(topic, ordinal, "query", "url", F.lit(True).alias("scoped"))
    none = plain.join(scoped.select(topic).distinct(), topic, "left_anti")
    return scoped.unionByName(none.join(results, "query").select(topic, ordinal, "query", "url", F.lit(False).alias("scoped")))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in the order of some columns, from 1.

    Rows are dealt out by ranges and numbered within each; the sizes of the ranges, a row
    for each, say where a range begins.  So no task sees all rows.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = Scratch(df.sparkSession, "numbered").table(dealt, "rows").withColumn("_part", F.shiftright("_id", 33))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    return dealt.join(F.broadcast(begins), "_part").withColumn(name, F.col("_before") + F.col("_id") - F.shiftleft("_part", 33) + 1).drop("_id", "_part", "_before")


def listed_first(df: DataFrame, hit: str, ordinal: str) -> DataFrame:
    """Adds ``place``: rows with a hit first, both kinds in their order."""
    return numbered(df.withColumn("_none", F.col(hit).isNull()), ["_none", ordinal], "place").drop("_none")


def grouped_sites(sites: DataFrame, types: list[str]) -> DataFrame:
    """(type, domains) in the catalogue's order of types."""
    rows = sites.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "domain"))), lambda r: r["domain"]).alias("domains"))
    return rows.withColumn("place", F.array_position(F.array(*map(F.lit, types)), F.col("type"))).filter("place > 0")


def materialised(queries: Column, topic: Column) -> Column:
    """Queries with the topic put in, trimmed; blanks and repeats left out."""
    return F.array_distinct(F.filter(F.transform(queries, lambda q: F.trim(F.replace(q, F.lit("{topic}"), F.trim(topic)))), lambda q: q != ""))


def content_type(topic: Column, keywords: dict[str, list[str]], mixed: str = "mixed") -> Column:
    """The one type whose words the topic holds, or mixed."""
    hits = F.filter(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(topic, w)), F.lit(name)) for name, words in keywords.items())), lambda v: v.isNotNull())
    return F.when(F.size(hits) == 1, F.get(hits, 0)).otherwise(mixed)


def signal_terms(topic: Column, script: Column, terms: dict[str, list[str]]) -> Column:
    """struct(key, terms) of the topics that a call names or its script uses; null if there are none."""
    named = F.transform(F.regexp_extract_all(F.lower(F.coalesce(script, F.lit(""))), F.lit(r"office\.([a-z]+)"), F.lit(1)), lambda v: v)
    ids = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.coalesce(topic, F.lit(""))), named), lambda v: v.isin(list(terms)))))
    table = F.create_map(*(x for k, v in terms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.when(F.size(ids) > 0, F.struct(F.array_join(ids, "+").alias("key"), F.array_distinct(F.flatten(F.transform(ids, lambda k: table[k]))).alias("terms")))


def tier_counts(df: DataFrame) -> DataFrame:
    """docs, chunks, bytes and documents of each tier, absent ones as 0."""
    return df.agg(F.count("*").alias("docs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), *(F.count_if(F.col("tier") == t).alias(t) for t in TIERS))


def status(stores: dict[str, DataFrame], size: str) -> DataFrame:
    """(store, rows, bytes) of each store."""
    out = None
    for name, df in stores.items():
        part = df.agg(F.lit(name).alias("store"), F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(size)), F.lit(0)).alias("bytes"))
        out = part if out is None else out.unionByName(part)
    return out


def status_report(stores: dict[str, DataFrame], size: str, edges: DataFrame, live: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(store, rows, bytes) of each store, and how many links dangle and how many ids are known to be dead."""
    none = F.lit(0).cast("long").alias("bytes")
    more = dangling(edges, live).agg(F.lit("dangling").alias("store"), F.count("*").alias("rows"), none).unionByName(tombstones.select("id").distinct().agg(F.lit("tombstones").alias("store"), F.count("*").alias("rows"), none))
    return status(stores, size).unionByName(more)


def live_ids(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Ids of entries, of documents, and of the chunks 1..n of each document's hash."""
    chunks = documents.filter("chunks > 0").select(F.explode(F.sequence(F.lit(1), F.col("chunks"))).alias("n"), "hash").select(F.concat_ws(":", F.lit("kb"), "hash", F.col("n").cast("string")).alias("id"))
    return entries.select("id").unionByName(documents.select("id")).unionByName(chunks).distinct()
