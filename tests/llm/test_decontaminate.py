import math
import random
import re

import numpy as np

from gristmill.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x20]+", re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", text).lower())


def brute(items, passage):
    """Normalised BM25 of every item for the words of a passage."""
    bags = {k: words(t) for k, t in items}
    average = sum(map(len, bags.values())) / len(bags)
    df = {}
    for bag in bags.values():
        for w in set(bag):
            df[w] = df.get(w, 0) + 1
    out = {}
    for k, bag in bags.items():
        weight = {}
        for w in set(bag):
            tf = bag.count(w)
            weight[w] = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / average))
        out[k] = sum(v for w, v in weight.items() if w in passage) / sum(weight.values())
    return out


def setting(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of"] * 100
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 40)))) for k in range(60)]
    docs = []
    for d in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 400))]
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(60)
            piece = items[k][1].split()
            if rng.random() < 0.5:
                piece = [w if rng.random() < 0.85 else "other" for w in piece]
            at = rng.randrange(len(text) + 1)
            text[at:at] = piece
        docs.append((d, " ".join(text)))
    return items, docs


def test_search_finds_all_above_the_threshold():
    items, docs = setting()
    bags = [dc.item_words(t) for _, t in items]
    at, n = np.unique(np.concatenate([np.unique(b) for b in bags]), return_counts=True)
    index = dc.build([k for k, _ in items], bags, len(items), float(np.mean([len(b) for b in bags])), dict(zip(at.tolist(), n.tolist(), strict=True)), max(map(len, bags)))
    hashes = [dc.item_words(t) for _, t in docs]
    first = np.cumsum([0, *map(len, hashes)])
    for threshold in (0.35, 0.5, 0.8):
        found = {(d, s - int(first[d]), k): v for d, s, k, v in dc.search(index, np.concatenate(hashes), first, threshold)}
        expected = {}
        for d, text in docs:
            w = words(text)
            for s in range(0, len(w), index.half):
                for k, v in brute(items, set(w[s:s + 2 * index.half])).items():
                    if v >= threshold:
                        expected[d, s, k] = v
        assert found.keys() == expected.keys()
        assert all(abs(found[x] - expected[x]) < 1e-9 for x in found)


def test_whole_copies_are_found_and_clean_documents_left(spark):
    rng = random.Random(1)
    items = [(k, " ".join(f"q{k}x{j}" for j in range(rng.randrange(5, 60)))) for k in range(40)]
    docs = [(d, " ".join(f"d{rng.randrange(500)}" for _ in range(rng.randrange(0, 500)))) for d in range(40)]
    leaks = {(d, d): docs[d][1] + "\n" + items[d][1].upper().replace(" ", ", ", 2) + " end" for d in range(0, 40, 3)}
    rows = [(d, leaks.get((d, d), t), "x") for d, t in docs] + [(100, None, "x"), (101, "", "x"), (102, "w " * 300_000 + items[1][1], "x"), (None, items[2][1], "x"), (7, docs[7][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    bench = spark.createDataFrame([*items, (None, "no id"), (77, None), (78, ""), (1, items[1][1])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(spark, df, bench).collect()}
    assert found == {*leaks, (102, 1), (None, 2)}
    clean = dc.clean(spark, df, bench)
    assert clean.schema == df.schema and clean.count() == len(rows) - len(leaks) - 2


def test_several_indexes_give_the_same(spark):
    items, docs = setting(3)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = list(dc.indexes(bench))
    many = list(dc.indexes(bench, 1500))
    assert len(one) == 1 and len(many) > 2
    import pyarrow as pa

    column = pa.array([t for _, t in docs])
    hits = lambda ix: set(dc._hits(ix, column))
    assert {h[:2] for h in hits(one[0])} == {h[:2] for ix in many for h in hits(ix)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.contaminated(spark, none, bench).collect() == []
    assert dc.contaminated(spark, spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), bench.limit(0)).collect() == []


def test_short_items_edited_copies_and_a_long_item(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(5000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(0, "the"), (1, "w1 w2 w3 w4"), (2, "alpha beta gamma delta epsilon"), (3, text(900)), (4, None), (5, ""), (None, text(20)), *((k, text(rng.randrange(15, 57))) for k in range(6, 40))]
    items.append((39, items[-1][1]))  # a repeated row
    docs, expected = [], set()
    for k, t in items[7:-1]:
        w = t.split()
        for at in (0, len(w) // 3, len(w) // 2, len(w) - 3, len(w) - 1):  # one word changed, anywhere
            d = len(docs)
            docs.append((d, f"{text(200)} {' '.join([*w[:at], 'other', *w[at + 1:]])} {text(100)}"))
            expected.add((d, k))
    docs.append((len(docs), text(50) + " alpha beta gamma delta epsilon " + text(50)))
    expected.add((len(docs) - 1, 2))
    docs.append((len(docs), text(300) + " " + items[3][1]))
    expected.add((len(docs) - 1, 3))
    clean = [(len(docs) + k, "the w1 w2 w3 w4 " + text(300)) for k in range(50)]
    halves = [(len(docs) + 50 + k, text(100) + " " + " ".join(t.split()[: len(t.split()) // 3]) + " " + text(100)) for k, (_, t) in enumerate(items[7:-1])]
    df = spark.createDataFrame(docs + clean + halves, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(spark, df, benchmark).collect()}
    assert found.keys() == expected
    for (d, k), r in found.items():  # the overlaps are shares of the item's runs of words
        bag, passage = words(dict(items)[k]), words(dict(docs)[d])
        cut = len(bag) - max(1, len(bag) // 4)
        for part, width, share in ((bag[:cut], 3, r["question_overlap"]), (bag[cut:], 2, r["answer_overlap"])):
            width = min(width, len(part))
            runs = {tuple(part[j:j + width]) for j in range(len(part) - width + 1)}
            held = {tuple(passage[j:j + width]) for j in range(len(passage) - width + 1)}
            assert abs(share - len(runs & held) / len(runs)) < 1e-9
