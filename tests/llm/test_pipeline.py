import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import decontaminate, line_dedup, minhash, quality

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark, tmp_path):
    """Each stage's output holds just what its operator's own query says of its input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = docs.toPandas().set_index("doc_id"), out.toPandas().set_index("doc_id")
        assert 0 < len(after) <= len(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name == "quality_rules":
            model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
            kept = {r["doc_id"] for r in quality.assess(spark, docs, model).filter("kept").collect()}
            assert set(after.index) == kept
        elif name == "line_dedup":
            whole = line_dedup.dedup_lines(spark, docs).toPandas().set_index("doc_id")["text"]
            assert set(after.index) == {d for d, t in whole.items() if t.split()}
            pd.testing.assert_series_equal(after["text"].sort_index(), whole.loc[after.index].sort_index())
            assert (after["n_chars"] == after["text"].str.len()).all()
        elif name == "minhash_near_dedup":
            kept = {r["doc_id"] for r in minhash.near_duplicates(spark, docs).filter("kept").collect()}
            assert set(after.index) == kept
        elif name == "benchmark_decontamination":
            hit = {r["doc_id"] for r in decontaminate.contaminated(spark, docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert set(after.index) == set(before.index) - hit
        else:
            assert set(after.index) == set(before.index) and (after["n_tokens"] == after["ids"].map(len)).all()
        docs = out


ROWS = [
    (None, "a row without an id\nand two lines", None, "s", None, "x", "y"), (None, None, "en", None, 0, None, None), (1, None, "en", "s", 0, "x", "y"), (2, "", "en", "s", 0, "x", "y"),
    (3, " \n\t\n ", "en", "s", 5, "x", "y"), *((4, "the same words stand here in a row that comes again and again\none more line", "en", "s", 70, "x", "y") for _ in range(3)),
    (4, "another text under an id that other rows have too", "de", "t", 50, "x", "y"), (5, "word " * 150_000 + "\nend", "en", "s", 750_004, "x", "y"),
    (6, "the same words stand here in a row that comes again and again\none more line", "en", "s", 70, "x", "y"),
]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(spark, stage):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with the names that operators use, and an empty table."""
    name, run = stage
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, gone_lines string"
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("own") for c in ("gone_id", "lines", "row", "kept", "all", "rep", "id", "tie", "n", "crc")})
        out = run(spark, docs, SMALL)
        found = out.collect()
        if name == "sentencepiece_encoding":
            assert len(found) == len(rows)
            continue
        assert out.columns == docs.columns
        assert all(r[c] == "own" for r in found for c in docs.columns[7:])
        kept = sorted(((r["doc_id"] or 0), (r["text"] or "")[:40]) for r in found)
        every = sorted(((r[0] or 0), (r[1] or "")[:40]) for r in rows)
        if name == "quality_rules":
            assert set(kept) <= set(every) and (0, "") not in kept and (2, "") not in kept
        elif name == "line_dedup":
            again = (4, "the same words stand here in a row that ")
            assert kept == [x for x in every if x != (6, "the same words stand here in a row that ")] and kept.count(again) == 3 * bool(rows)
        elif name == "minhash_near_dedup":
            ids = [r["doc_id"] for r in found]
            assert sorted(x or 0 for x in ids) == ([0, 0, 1, 2, 3, 4, 5] if rows else [])
        else:
            assert kept == every
