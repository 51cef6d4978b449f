"""The knowledge base: manifests and chunks as tables, their check, reading and search.

A manifest has a row for each document, addressed by its path; chunks are addressed by the
hash of the content, so documents of equal content share them, and what belongs to the
document (path, tier, time) is taken from the manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, trimmed, truncate
from ..functions.values import bounded_int
from ..scratch import Scratch
from ..sources.stores import json_lines
from . import search

MANIFEST = "id string, path string, hash string, title string, bytes double, chars double, chunks double, tier string, at string"
CHUNK = "id string, n double, text string, span struct<start:double,end:double>, outline string, hash string"
MOST_CHUNKS, MOST_NUMBER = 100_000, 1_000_000
TIER = "user"  # of documents that name none, or none that is known
PREVIEW_CHARS = 240
ROUTE_WEIGHT = 0.75


def _text(name: str) -> Column:
    return trimmed(F.coalesce(F.col(name).cast("string"), F.lit("")))


def doc_id(path: Column) -> Column:
    return F.concat(F.lit("kb:"), content_hash(path, ""))


def chunk_id(hash_: Column, n: Column) -> Column:
    return F.concat_ws(":", F.lit("kb"), hash_, bounded_int(n, 0, 0, MOST_NUMBER).cast("string"))


def header(outline: Column, source: Column, at: Column) -> Column:
    """Outline, source and day, those that there are."""
    some = lambda x: F.nullif(trimmed(F.coalesce(x.cast("string"), F.lit(""))), F.lit(""))
    return F.concat_ws(" · ", some(outline), F.concat(F.lit("来源 "), some(source)), F.nullif(F.substring(some(at), 1, 10), F.lit("")))


def title(text: Column, path: Column) -> Column:
    """The first heading of the first level, else the file's name."""
    found = trimmed(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^[ \t]{0,3}#[ \t]+(\S.*?)[ \t]*$", 1))
    name = F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)
    return F.when(found != "", found).when(name != "", name).otherwise(path)


def manifest_rows(raw: DataFrame) -> DataFrame:
    """Manifest rows put in order: those without id or hash go, an unknown tier becomes the usual one, numbers are cut to their range."""
    number = lambda name: F.when(F.col(name).isNull() | F.isnan(name) | (F.abs(name) == float("inf")), 0.0).otherwise(F.col(name)).cast("long")
    rows = raw.select(*(_text(c).alias(c) for c in ("id", "path", "hash", "title", "at")), F.lower(_text("tier")).alias("tier"), number("bytes").alias("bytes"), number("chars").alias("chars"), bounded_int(F.col("chunks"), 0, 0, MOST_CHUNKS).cast("int").alias("chunks"))
    rows = rows.filter("id <> '' AND hash <> ''").withColumn("title", F.when(F.col("title") == "", F.col("path")).otherwise(F.col("title")))
    return rows.withColumn("tier", F.when(F.col("tier").isin(*search.TIERS), F.col("tier")).otherwise(TIER))


def chunk_rows(raw: DataFrame) -> DataFrame:
    """Chunk rows put in order: those without id or text go, a missing hash is made.  ``doc_hash`` comes from the id."""
    at = lambda name: F.coalesce(F.col(f"span.{name}"), F.lit(0)).cast("long")
    rows = raw.filter((_text("id") != "") & (F.coalesce("text", F.lit("")) != ""))
    made = F.when(_text("hash") == "", content_hash(F.col("text"), "")).otherwise(_text("hash"))
    return rows.select(_text("id").alias("id"), bounded_int(F.col("n"), 0, 0, MOST_NUMBER).cast("int").alias("n"), "text", at("start").alias("start"), at("end").alias("end"), _text("outline").alias("outline"), made.alias("hash"), F.element_at(F.split(_text("id"), ":"), -2).alias("doc_hash"))


def self_consistent(chunks: DataFrame) -> Column:
    """Whether a chunk's text still has the hash that was stored with it."""
    return chunks["hash"] == content_hash(chunks["text"], "")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, chunks) of a knowledge base's folder: manifest.jsonl and chunks/<hash>/<n>.json; bad rows are passed over."""
    raw = spark.read.schema(CHUNK).option("mode", "DROPMALFORMED").option("multiLine", True).option("recursiveFileLookup", True).json(f"{folder}/chunks")
    return manifest_rows(json_lines(spark, f"{folder}/manifest.jsonl", MANIFEST)), chunk_rows(raw)


def joined(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk of every document, with the document's id, path, title, tier and time and the chunk's header.

    Chunks count whose number the document has and whose text is what was stored.
    """
    good = chunks.filter(self_consistent(chunks)).select(F.col("id").alias("chunk_id"), "doc_hash", "n", "text", "start", "end", "outline").dropDuplicates(["chunk_id"])
    docs = manifest.select(F.col("id").alias("doc_id"), "path", "title", "tier", "at", F.col("hash").alias("doc_hash"), "chunks")
    both = docs.join(good, "doc_hash").filter("n BETWEEN 1 AND chunks")
    return both.withColumn("header", header(F.col("outline"), F.col("path"), F.col("at"))).drop("chunks")


def missing(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, found, missing): chunks that a document names and that are not there or were changed."""
    have = joined(manifest, chunks).groupBy("doc_id").agg(F.count_distinct("n").alias("found"))
    docs = manifest.select(F.col("id").alias("doc_id"), "chunks").join(have, "doc_id", "left")
    return docs.select("doc_id", "chunks", F.coalesce("found", F.lit(0)).alias("found"), (F.col("chunks") - F.coalesce("found", F.lit(0))).alias("missing"))


def chosen(manifest: DataFrame, tier: str = "", path: str = "") -> DataFrame:
    """Documents of a tier and of a path, where they are given; a tier that does not exist is an error."""
    if tier:
        manifest = manifest.filter(F.col("tier") == search.check_tier(tier))
    return manifest.filter(F.col("path") == path) if path else manifest


def candidates(manifest: DataFrame, chunks: DataFrame, tier: str = "", path: str = "", most: int | None = None) -> DataFrame:
    """Chunks to search, each once: of several documents that share one the first by id has it.  ``most`` is a guard on their number, off by default."""
    rows = joined(chosen(manifest, tier, path), chunks)
    first = rows.groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    rows = rows.join(first, ["chunk_id", "doc_id"], "left_semi").dropDuplicates(["chunk_id"])
    return rows if most is None else rows.orderBy("doc_id", "n").limit(most)


def find(manifest: DataFrame, chunks: DataFrame, query: str, k: int = 20, tier: str = "", path: str = "", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, summary) of a search over chunk texts and headers.

    Hits are the best chunks that share a term with the query, with a preview of their
    text; none are made up where nothing overlaps.  The summary is one row with the
    reason: hits, filter-empty (no document is left to search), no-chunks (none can be
    read) or no-overlap.
    """
    spark = manifest.sparkSession
    if not query.strip():
        raise ValueError("a search needs a query")
    docs = chosen(manifest, tier, path)
    rows = Scratch(spark, "kb").table(candidates(manifest, chunks, tier, path, most), "candidates")
    terms = search.query_terms(spark, query)
    scored = search.two_routes(rows, "chunk_id", "text", "header", terms, ROUTE_WEIGHT)
    best = search.top_k(scored, "chunk_id", k, 20).withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "chunk_id")))  # at most 20 rows
    hits = best.join(rows, "chunk_id").select("place", "chunk_id", "doc_id", "path", "title", "tier", "n", "score", "header", "start", "end", F.length("text").alias("chars"), truncate(F.col("text"), PREVIEW_CHARS).alias("preview"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    lacking = missing(docs, chunks).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    summary = one(docs, "docs").crossJoin(one(rows, "chunks")).crossJoin(one(scored, "matched")).crossJoin(lacking)  # four rows of one
    reason = F.when(F.col("matched") > 0, "hits").when(F.col("docs") == 0, "filter-empty").when(F.col("chunks") == 0, "no-chunks").otherwise("no-overlap")
    return hits, summary.select(reason.alias("reason"), "docs", "chunks", "matched", "missing", (F.col("matched") > max(1, min(k, 20))).alias("truncated"))
