"""Toxicity: logistic regression on hashed words and word beginnings, with counterfactual regularisation.

A document's value for a feature is the feature's share of its words.  Features that do
not tell the classes apart on the training rows (a two-sided test of document
frequencies) get no weight, so that long clean texts do not add up chance words.

Counterfactuals: wherever a labelled text of the training fold names a group, the name is
swapped for every other of the same kind, and the mean squared change of the text's score
(its logit) joins the loss.  A swap moves a name's share of the text's words from its own
features to the other's, so the change is that share times the difference of two sums of
weights, and the sum over all texts needs only the squared shares of each name.
Mentioning a group then says nothing by itself, whichever group's name the toxic rows
happen to hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._linear import labelled, platt
from ._store import ship
from ._text import U64, blocks, hash_words, mix, prefix_sums, span_hashes, word_bounds
from .decontaminate import NORMAL

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Besides whole words, their first so many bytes.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled rows used for training: those with the smallest hash of their doc_id.
SAMPLE = 2500
THRESHOLD = 0.3
SCALE = 50.0
SWAP_WEIGHT = 1.0
#: Least deviations between the classes' document frequencies for a feature to count.
LEAST_Z = 4.0

#: Names of groups by kind; each is swapped for the others of its kind.
IDENTITY = [
    "women men girls boys females males".split(),
    "woman man girl boy female male".split(),
    "muslims christians jews hindus buddhists atheists catholics".split(),
    "muslim christian jewish hindu buddhist atheist catholic".split(),
    "black white asian latino african european arab".split(),
    "gay straight lesbian bisexual transgender heterosexual queer".split(),
    "immigrants refugees natives foreigners citizens".split(),
    "disabled blind deaf autistic elderly young".split(),
    "americans mexicans chinese indians russians germans french".split(),
]


def _family(hashes: np.ndarray, k: int) -> np.ndarray:
    return (mix(hashes + U64(k * 0x9E3779B97F4A7C15 % 2**64)) >> U64(64 - BUCKET_BITS)).astype(np.int64)


def buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words x families of buckets, word hashes, first word of each document and the total); words as short as a beginning have none in that family."""
    starts, ends, first = word_bounds(raw, at)
    sums = prefix_sums(raw)
    hashes = span_hashes(sums, starts, ends)
    out = [_family(hashes, 0)]
    for k, size in enumerate(BEGINNINGS, 1):
        long = ends - starts > size
        found = np.full(len(starts), BUCKETS, np.int64)
        found[long] = _family(span_hashes(sums, starts[long], starts[long] + size), k)
        out.append(found)
    return np.stack(out, axis=1) if len(starts) else np.zeros((0, len(out)), np.int64), hashes, first


def _names() -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all names, sorted by hash: the hashes, the features of each, and its kind."""
    one = lambda w: buckets(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]
    names = [(w, k) for k, kind in enumerate(IDENTITY) for w in kind]
    hashes = hash_words([w for w, _ in names])
    order = np.argsort(hashes)
    return hashes[order], [one(names[k][0]) for k in order], np.array([names[k][1] for k in order])


@dataclass
class Toxicity:
    weights: np.ndarray  # a last, zero weight stands for "no such feature"
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for _, _, raw, at in blocks(column):
            found, _, first = buckets(NORMAL[raw], at)
            sums = np.zeros(len(found) + 1)
            np.cumsum(self.weights[found].sum(axis=1), out=sums[1:])
            z = SCALE * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30))))
        return np.concatenate(out)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _names()[0]
    for batch in batches:
        ids, values, swapped = [], [], []
        for a, b, raw, at in blocks(batch.column(1)):
            found, hashes, first = buckets(NORMAL[raw], at)
            for k in range(b - a):
                mine = found[first[k]:first[k + 1]]
                flat, counts = np.unique(mine[mine < BUCKETS], return_counts=True)
                ids.append(flat.astype("<i4").tobytes())
                values.append((counts / max(1, len(mine))).astype("<f4").tobytes())
                words = hashes[first[k]:first[k + 1]]
                place = np.searchsorted(names, words)
                place[place == len(names)] = 0
                hit = place[names[place] == words]
                swapped.append((np.bincount(hit, minlength=len(names)) / max(1, len(words))).astype("<f4").tobytes() if len(hit) else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.binary()) for x in (ids, values, swapped))], ["doc_id", "label", "ids", "values", "swapped"])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = 150, swap_weight: float = SWAP_WEIGHT) -> Toxicity | None:
    """The classifier from labelled rows; None without rows of both classes.  A fifth of them is kept for calibration."""
    rows = labelled(documents, labels, "toxic", sample).mapInArrow(_featured, "doc_id long, label int, ids binary, values binary, swapped binary").toArrow().sort_by([("doc_id", "ascending")])
    y = np.array(rows.column("label").to_pylist(), float)
    if len(y) == 0 or y.min() == y.max():
        return None
    ids = [np.frombuffer(x, "<i4") for x in rows.column("ids").to_pylist()]
    values = [np.frombuffer(x, "<f4") for x in rows.column("values").to_pylist()]
    n = np.array([len(x) for x in ids])
    flat, x, row = np.concatenate(ids), np.float32(SCALE) * np.concatenate(values), np.repeat(np.arange(len(n), dtype=np.int32), n)
    del ids, values
    fold = np.arange(len(y)) % 5 == 4
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold[:] = False
    train = ~fold
    n1, n0 = (y[train] == 1).sum(), (y[train] == 0).sum()
    d1 = np.bincount(flat[train[row] & (y[row] == 1)], minlength=BUCKETS)
    d0 = np.bincount(flat[train[row] & (y[row] == 0)], minlength=BUCKETS)
    p1, p0, p = (d1 + 0.5) / (n1 + 1), (d0 + 0.5) / (n0 + 1), (d1 + d0 + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    kept = np.flatnonzero((np.abs(z) >= LEAST_Z) & (d1 + d0 >= 5))
    spot = np.full(BUCKETS + 1, len(kept))
    spot[kept] = np.arange(len(kept))
    use = spot[flat] < len(kept)
    flat, x, row = spot[flat[use]], x[use], row[use]
    # Mean squared shares of each name in the training rows; swapping moves a share to another name's features.
    _, own, kind = _names()
    shares = np.zeros(len(own))
    for k, text in enumerate(rows.column("swapped").to_pylist()):
        if text and train[k]:
            shares += (SCALE * np.frombuffer(text, "<f4").astype(float)) ** 2
    shares /= train.sum()
    own = np.array([spot[a] for a in own])
    others = (kind[:, None] == kind[None]) & ~np.eye(len(kind), dtype=bool)
    pull = shares[:, None] * others / others.sum(axis=1, keepdims=True)  # name x other: weight of the squared difference
    pull = pull + pull.T
    size = len(kept) + 1
    u, bias, m, v = np.zeros(size + 1), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    weight = train / train.sum()
    for step in range(1, steps + 1):
        score = np.bincount(row, x * u[flat], len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * weight
        g = np.zeros(size + 1)
        g[:size] = np.bincount(flat, x * error[row], size) + 1e-4 * u[:size]
        sums = u[own].sum(axis=1)
        np.add.at(g, own, (2 * swap_weight * (pull.sum(axis=1) * sums - pull @ sums))[:, None])
        g[len(kept)] = 0
        g[size] = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        u[size] = bias
        u -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        u[len(kept)], bias = 0, u[size]
    weights = np.zeros(BUCKETS + 1, np.float32)
    weights[kept] = u[:len(kept)]
    model = Toxicity(weights, float(bias))
    score = np.bincount(row, x * u[flat], len(y)) + bias
    held = fold if fold.any() else train
    model.slope, model.shift = platt(score[held], y[held])
    return model


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _scored(model: Toxicity | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column(2)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``.

    Rows whose crc32(doc_id as text) leaves 2 by 4 are held out: their labels are never
    read.  Null and empty texts get the score of a text without known words; without
    training rows of both classes every score is 0.  Rows without a doc_id are scored and
    not held out; rows are neither dropped nor merged, and other columns are ignored.
    """
    ship(spark)
    model = fit(documents, labels.filter(~held_out(F.col("doc_id").cast("long"))))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return docs.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")
