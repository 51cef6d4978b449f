"""Lexical search: BM25 over tokens, two routes fused, bounded reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms, search_tokens
from ..scratch import Scratch

K1, B = 1.2, 0.75
TIERS = ("unverified", "user", "verified")


def query_terms(spark, query: str) -> list[str]:
    return spark.range(1).select(search_terms(F.lit(query)).alias("t")).first()["t"]


def term_counts(docs: DataFrame, key: str, columns: dict[str, str], terms: list[str]) -> DataFrame:
    """key and, for each named text column, its length in tokens and the frequency of every term; a few numbers a row.

    Frequencies are counted inside each row's token array, so nothing is exploded.
    """
    tokens = docs.select(key, *(search_tokens(F.col(c)).alias(f"_{name}") for name, c in columns.items()))
    hits = lambda name: F.filter(f"_{name}", lambda t: t.isin(terms)) if terms else F.array().cast("array<string>")
    tokens = tokens.select(key, *(x for name in columns for x in (F.size(f"_{name}").alias(f"{name}_dl"), hits(name).alias(f"_{name}"))))
    count = lambda name, t: F.size(f"_{name}") - F.size(F.array_remove(f"_{name}", t))
    return tokens.select(key, *(x for name in columns for x in (f"{name}_dl", *(count(name, t).alias(f"{name}_tf{k}") for k, t in enumerate(terms)))))


def scores(counted: DataFrame, key: str, names: list[str], n_terms: int, k1: float = K1, b: float = B) -> DataFrame:
    """key and a BM25 score for each name, from ``term_counts``; the statistics are one row of numbers."""
    per = [F.avg(f"{x}_dl").alias(f"{x}_avgdl") for x in names] + [F.count_if(F.col(f"{x}_tf{k}") > 0).alias(f"{x}_df{k}") for x in names for k in range(n_terms)]
    both = counted.crossJoin(F.broadcast(counted.agg(F.count("*").alias("_n"), *per)))  # one row

    def score(x: str) -> Column:
        parts = [F.lit(0.0)]
        for k in range(n_terms):
            tf, df = F.col(f"{x}_tf{k}"), F.col(f"{x}_df{k}")
            idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
            parts.append(F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"{x}_dl") / F.greatest(f"{x}_avgdl", F.lit(1e-9))))).otherwise(0.0))
        return sum(parts[1:], parts[0])

    return both.select(key, *(score(x).alias(x) for x in names))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of all rows, 0 for those without any term.

    Texts are read and tokenised once, into a written table of a few numbers a row, from
    which the statistics and then the scores come.
    """
    counted = Scratch(docs.sparkSession, "bm25").table(term_counts(docs, key, {"score": text}, terms), "counts")
    return scores(counted, key, ["score"], len(terms), k1, b)


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """token, df over all rows, with the number of rows and their mean length."""
    tokens = docs.select(F.monotonically_increasing_id().alias("id"), search_tokens(F.col(text)).alias("tokens"))
    shape = tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avgdl"))
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(shape))


def two_routes(docs: DataFrame, key: str, body: str, head: str, terms: list[str], weight: float = 0.75) -> DataFrame:
    """Scores of body and head, each over its largest, weighted; rows with no term in either are left out.

    One pass over the texts counts the terms of both columns; the rest works on those numbers.
    """
    counted = Scratch(docs.sparkSession, "routes").table(term_counts(docs, key, {"body": body, "head": head}, terms), "counts")
    both = scores(counted, key, ["body", "head"], len(terms))
    top = both.agg(F.max("body").alias("body_top"), F.max("head").alias("head_top"))
    share = lambda x: F.when(F.col(f"{x}_top") > 0, F.col(x) / F.col(f"{x}_top")).otherwise(0.0)
    return both.filter("body > 0 OR head > 0").crossJoin(F.broadcast(top)).select(key, (weight * share("body") + (1 - weight) * share("head")).alias("score"))


def top_k(scored: DataFrame, key: str, k: int = 8, hard: int = 20) -> DataFrame:
    """The k best, ties by key; the limit is the operator's purpose."""
    return scored.orderBy(F.col("score").desc(), F.col(key)).limit(max(1, min(k, hard)))


def bounded_read(chunks: DataFrame, doc: str, order: str, text: str, most_chars: int = 4000, most_chunks: int = 12) -> DataFrame:
    """Of each document its first chunk, and further ones while they fit into the characters and their number."""
    w = Window.partitionBy(doc).orderBy(order)
    so_far = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("n", F.row_number().over(w)).withColumn("chars", so_far).filter((F.col("n") == 1) | ((F.col("chars") <= most_chars) & (F.col("n") <= most_chunks)))


def check_tier(tier: str) -> str:
    if tier not in TIERS:
        raise ValueError(f"no such tier: {tier}")
    return tier


def strictest(tier: Column) -> Column:
    """Aggregate: the least trusted tier."""
    return F.min_by(tier, F.array_position(F.array(*map(F.lit, TIERS)), tier))
