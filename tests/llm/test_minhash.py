import random
import re

import oracle
import pytest

from gristmill.llm import minhash, queries

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    """Components over exact Jaccard similarities of five-word shingle sets; rows of one doc_id are linked."""
    sets = []
    for doc, text in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append((doc, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {doc: doc for doc, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((top(a), top(b)))
                parent[v] = u
    return {doc: (len(s), top(doc)) for doc, s in sets}


def texts(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 40, 120]))]
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            rows.append((n, text.upper() if rng.random() < 0.2 else text))
            n += 1
    return [*rows, (n, ""), (n + 1, None), (n + 2, " \t\n "), (n + 3, "one"), (n + 4, "ONE "), (n + 5, "long " * 30_000), (n + 6, "long " * 29_000)]


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_shingles int, component_id string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, df).collect()}
    assert found == {d: (n, c, c == d) for d, (n, c) in brute(rows).items()}


def test_empty_null_ids_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(spark, empty).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    found = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(spark, df).collect())
    assert found == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted(r["doc_id"] or -1 for r in minhash.deduplicated(spark, df).collect()) == [-1, 1]


def test_rows_that_repeat_an_id_link_their_texts(spark):
    a, b, c = "a b c d e f", "u v w x y z", "k l m n o p"
    df = spark.createDataFrame([(0, a), (1, a), (1, b), (2, b), (2, ""), (3, c), (4, None)], "doc_id long, text string")
    found = sorted(tuple(r) for r in minhash.near_duplicates(spark, df).collect())
    assert found == [(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False), (2, 0, 0, False), (2, 2, 0, False), (3, 2, 3, True), (4, 0, 4, True)]
    rng = random.Random(12)
    rows = [(rng.randrange(len(texts())) if rng.random() < 0.3 else d, t) for d, t in texts(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {}
    top = {}
    for (d, t), (n, _) in zip(rows, [brute([r])[r[0]] for r in rows], strict=True):
        expected.setdefault(d, []).append(n)
    components = brute([(k, t) for k, (_, t) in enumerate(rows)])
    links = [(d, rows[components[k][1]][0]) for k, (d, _) in enumerate(rows)]
    top = {d: d for d, _ in rows}
    for _ in rows:  # until the smallest id has reached everything
        for x, y in links:
            top[x] = top[y] = min(top[x], top[y])
    found = minhash.near_duplicates(spark, df).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == top
    assert sorted((r["doc_id"], r["n_shingles"]) for r in found) == sorted((d, n) for d, ns in expected.items() for n in ns)


def test_query(spark):
    assert oracle.differences(queries.QUERIES["op1_minhash_near_dedup"](spark, SMALL), oracle.connect(SMALL), queries.ORACLE["op1_minhash_near_dedup"]) == ""


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_signature_is_minimum_and_maximum(size):
    import numpy as np

    items = np.random.default_rng(size).integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
    x = (items >> np.uint64(32)).astype(np.uint32)
    every = x[None] * minhash._A[:, None] + minhash._B[:, None]
    assert (minhash.signature(items) == np.concatenate([every.min(axis=1), every.max(axis=1)])).all()
