import random
import re

import oracle

from gristmill.llm import line_dedup, queries

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    lines = sorted((d, k, tuple(re.findall(r"[^\x20\x09-\x0D]+", s)), s) for d, t in rows if t is not None for k, s in enumerate(t.split("\n")))
    out = {d: [] for d, _ in rows}
    for i, (d, _, w, s) in enumerate(lines):
        gone = len(w) >= 1 and any(w == x or (len(w) >= 8 and len(x) >= 8 and one_edit(w, x)) for _, _, x, _ in lines[:i])
        if not gone:
            out[d].append(s)
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.choice([1, 4, 5, 8, 9, 16, 30]))] for _ in range(30)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(0, 8)):
            w = list(rng.choice(base))
            change = rng.randrange(5)
            if change == 0:
                w[rng.randrange(len(w))] = "new"
            elif change == 1:
                w.insert(rng.randrange(len(w) + 1), "more")
            elif change == 2 and len(w) > 1:
                del w[rng.randrange(len(w))]
            lines.append("  ".join(w) + rng.choice(["", " ", "\t"]))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "w " * 20_000 + "\n" + "w " * 20_001)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, lines string, line int")
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark, df).collect()}
    expected = {d: None if dict(rows)[d] is None else "\n".join(s) for d, s in brute(rows).items()}
    assert found == expected


def test_empty_null_ids_and_repeats(spark):
    assert line_dedup.dedup_lines(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    line = "one two three four five"
    df = spark.createDataFrame([(None, line), (1, line), (1, line), (2, f"{line}\nx")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.dedup_lines(spark, df).collect()) == [(-1, line), (1, line), (1, line), (2, "x")]


def test_stage_keeps_columns_and_drops_what_is_left_empty(spark):
    line = "one two three four five"
    df = spark.createDataFrame([(1, line, "en", "s", 23), (2, line, "en", "s", 23), (3, f"{line}\nmore", "de", "t", 28)], "doc_id long, text string, lang string, source string, n_chars long")
    out = line_dedup.deduplicated(spark, df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, line, "en", "s", 23), (3, "more", "de", "t", 4)]


def test_query(spark):
    assert oracle.differences(queries.QUERIES["op2_line_dedup"](spark, SMALL), oracle.connect(SMALL), queries.ORACLE["op2_line_dedup"]) == ""


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b c d e\na b c d e")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(spark, df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_document_of_many_lines(spark):
    """20,000 lines, a third of them equal or within one edit of an earlier one: work in proportion to the lines."""
    rng = random.Random(6)
    lines, gone = [], set()
    for k in range(20_000):
        kind = rng.randrange(6) if k else 5
        if kind == 0:
            lines.append(lines[rng.randrange(k)])
            gone.add(k)
        elif kind == 1:
            w = lines[rng.randrange(k)].split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = f"new{k}"
            else:
                w.insert(rng.randrange(len(w) + 1), f"more{k}")
            lines.append(" ".join(w))
            gone.add(k)  # it is within one edit of the line that it was made from
        else:
            lines.append(" ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(10, 30))))
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    row = line_dedup.dedup_lines(spark, df).first()
    assert row["n_lines"] == 20_000 and row["n_removed"] == len(gone)
    assert row["text"] == "\n".join(x for k, x in enumerate(lines) if k not in gone)


def test_long_lines(spark):
    """Lines of 60,000 words that differ in one word, at either end and in the middle."""
    words = [f"w{k % 977}" for k in range(60_000)]
    variants = [words, ["x", *words[1:]], [*words, "y"], [*words[:30_000], *words[30_001:]], [*words[:10], "a", "b", *words[12:]]]
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(variants)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark, df).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}
