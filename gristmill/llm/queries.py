"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, line_dedup, minhash, pii, quality, secret_scan, sentencepiece_codec, token_store, toxicity
from ._store import ship


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(spark, _table(spark, folder, "documents"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(spark, _table(spark, folder, "documents"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find(spark, _table(spark, folder, "documents"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.assess(spark, docs, quality.fit(docs, _table(spark, folder, "labels")))


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.digests(_table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(spark, _table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts are made of control strings."""
    import public_tokenizers

    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.round_trip(spark, rows, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_store(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.store(spark, _table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(spark, _table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_secrets": op4_secrets,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_token_store": op9_token_store,
    "op10_decontamination": op10_decontamination,
}

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.o)
SELECT n.doc_id, n.n AS n_shingles, min(o) AS component_id, min(o) = n.doc_id AS kept FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n
""",
    "op2_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
w AS (SELECT doc_id, k, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
f AS (SELECT w, min({'d': doc_id, 'k': k}) AS f FROM w WHERE len(w) >= 1 GROUP BY w),
v AS (SELECT w, f, i, list_concat(w[1:i - 1], w[i + 1:]) AS v FROM (SELECT w, f, unnest(generate_series(1, len(w))) AS i FROM f WHERE len(w) >= 8)),
near AS (SELECT v.w FROM v JOIN (SELECT i, v, min(f) AS m FROM v GROUP BY i, v) m ON v.i = m.i AND v.v = m.v WHERE m.m < v.f
 UNION SELECT a.w FROM f a JOIN v ON v.v = a.w WHERE len(a.w) >= 8 AND v.f < a.f UNION SELECT v.w FROM f a JOIN v ON v.v = a.w WHERE len(a.w) >= 8 AND a.f < v.f),
g AS (SELECT w.*, f.f IS NOT NULL AND ({'d': w.doc_id, 'k': w.k} <> f.f OR near.w IS NOT NULL) AS gone FROM w LEFT JOIN f ON w.w = f.w LEFT JOIN near ON near.w = w.w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text FROM g GROUP BY 1
""",
}
