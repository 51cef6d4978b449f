import random
import zlib

import pytest

from gristmill.llm import quality, toxicity

SMALL = "/root/testdata/sf0.01"


def counts(text):
    """What the contract says, plainly."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line in seen and re.search(r"[^\x20\x09-\x0D]", line):
            dup += 1
        seen.add(line)
    where = {}
    for k in range(len(words) - 7):
        where.setdefault(tuple(words[k:k + 8]), []).append(k)
    repeated = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_quality_counts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\n ", "a", "é ü|" * 30, "same line\nsame line\n\n\nsame line \n", "a b c d e f g h " * 9, "x " * 200_000]
    texts += ["".join(rng.choice(["ab", " ", "\n", "é", "#", "\t", " ", "a b c d e f g h\n"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, "x", True) for k, t in enumerate(texts)], "doc_id long, text string, score string, kept boolean")
    rows = {r["doc_id"]: r for r in quality.assess(spark, df, None).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts(t), repr(t)[:80]
        assert r["kept"] is not r["base_failed"]
    assert quality.assess(spark, spark.createDataFrame([], "doc_id long, text string"), None).collect() == []


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def test_quality_verdicts(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.assess(spark, docs, model).join(labels.filter("doc_id % 2 = 1").dropDuplicates(["doc_id"]), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert quality.fit(docs, labels.filter("quality = 1")) is None


def test_quality_stage_keeps_rows_whole(spark, tables):
    docs, labels = tables
    out = quality.accepted(spark, docs, quality.fit(docs, labels))
    assert out.schema == docs.schema and 0 < out.count() < docs.count()


def test_toxicity(spark, tables):
    docs, labels = tables
    rows = toxicity.score(spark, docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    pairs = [(a["score"], b["score"]) for a in held for b in held if a["toxic"] > b["toxic"]]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.75
    assert sum(r["predicted"] for r in held if not r["toxic"]) == 0


def test_toxicity_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "x " * 100_000, 3.0)], "doc_id long, text string, score double")
    assert sorted((r["doc_id"] or -1, r["score"], r["predicted"]) for r in toxicity.score(spark, df, none).collect()) == [(-1, 0.0, 0), (1, 0.0, 0), (1, 0.0, 0)]


def test_counterfactuals_even_out_groups(spark):
    """Toxic rows name one group, clean ones another; scores of plain mentions must come together."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 2
        text = [rng.choice(words) for _ in range(20)] + (["vile", "scum"] if toxic else ["kind", "calm"])
        if rng.random() < 0.5:
            text.append("women" if toxic else "men")
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    import numpy as np
    import pyarrow as pa

    kind = toxicity.IDENTITY[0]
    names = [w for w in kind if w in ("women", "men")]

    def change(model):
        """Mean squared change of the logit over the texts, each name swapped for every other of its kind and the text scored again."""
        def logits(texts):
            p = model.scores(pa.array(texts))
            return (np.log(p / (1 - p)) - model.shift) / model.slope

        total = 0.0
        for k, (_, text) in enumerate(rows):
            found = [w for w in names if w in text.split()]
            if k % 5 != 4 and found:
                swapped = [" ".join(b if x == found[0] else x for x in text.split()) for b in kind if b != found[0]]
                z = logits([text, *swapped])
                total += ((z[1:] - z[0]) ** 2).mean()
        return total / sum(k % 5 != 4 for k in range(len(rows)))

    shipped, free = toxicity.fit(docs, labels), toxicity.fit(docs, labels, swap_weight=0.0)
    print(change(shipped), change(free))
    assert change(shipped) < 0.25 * change(free)
    one, two = shipped.scores(pa.array(["women w1 w2 w3", "men w1 w2 w3"]))
    more, less = free.scores(pa.array(["women w1 w2 w3", "men w1 w2 w3"]))
    assert abs(one - two) < 0.5 * abs(more - less)
    found = shipped.scores(pa.array([t for _, t in rows])) >= toxicity.THRESHOLD
    assert (found == np.arange(len(rows)) % 2).mean() > 0.97


def test_a_sample_row_for_each_labelled_id(spark):
    from gristmill.llm import _linear

    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (4, 1), (None, 1), (3, 7)], "doc_id long, quality int")
    rows = _linear.labelled(docs, labels, "quality", 10).collect()
    assert sorted((r["doc_id"], r["label"]) for r in rows) == [(1, 1), (2, 1)]


def test_character_grams_are_of_code_points():
    import numpy as np

    from gristmill.llm import _linear
    from gristmill.llm._text import word_hashes

    texts = ["äöüß naïve", "", "x", "日本語の文"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = list(_linear.families(raw, at, *word_hashes(raw, at)))
    for width, (grams, lo, hi) in zip((3, 4), found[2:], strict=True):
        for k, t in enumerate(texts):
            alone = [_linear.char_grams(np.array([ord(c) for c in t[j:j + width]], np.uint32), width)[0] for j in range(len(t) - width + 1)]
            assert grams[lo[k]:hi[k]].tolist() == alone


def test_quality_score_by_plain_sums():
    import numpy as np

    from gristmill.llm import _linear
    from gristmill.llm._text import U64, hash_words, windows, word_hashes

    rng = np.random.default_rng(3)
    model = _linear.Linear(rng.normal(size=(_linear.FAMILIES, _linear.BUCKETS)).astype(np.float32), 0.25)
    texts = ["one two  three\nfour", "", "é", "ab", "naïve über " * 30, "word", " \t "]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = model.raw_scores(raw, at, *word_hashes(raw, at))
    for t, score in zip(texts, found, strict=True):
        words = hash_words(t.split())
        families = [
            [int(h >> U64(48)) for h in words], [int(windows(words[k:k + 2], 2)[0] >> U64(48)) for k in range(len(words) - 1)],
            *([int(_linear.char_grams(np.array([ord(c) for c in t[k:k + n]], np.uint32), n)[0]) for k in range(len(t) - n + 1)] for n in (3, 4)),
        ]
        plain = 0.25 + sum(np.mean([float(model.weights[f][b]) for b in grams]) for f, grams in enumerate(families) if grams)
        assert score == pytest.approx(plain, abs=1e-4)
