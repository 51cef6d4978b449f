"""Logistic regression over hashed n-grams, scored on Arrow batches.

Four families of features, each hashed to 2^16 buckets: words, pairs of words, and
runs of three and four characters.  A document's value in a bucket is the bucket's share of
its family's n-grams, so scores do not depend on length and one pass of gathers and
cumulative sums scores a block of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import frugal
from ._text import SMALL_BLOCK, U64, blocks, windows, word_hashes

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
FAMILIES = 4
#: Labelled rows used for training: those with the smallest hash of their doc_id.
SAMPLE = 1000


def char_grams(chars: np.ndarray, width: int) -> np.ndarray:
    """Buckets of all runs of so many code points."""
    n = len(chars) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.zeros(n, np.uint32)
    for k, c in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[:width]):
        h += (chars[k:k + n] + np.uint32(1)) * np.uint32(c)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BUCKET_BITS)


def families(raw: np.ndarray, at: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets of all n-grams in the block, first n-gram of each document, one past its last) for each family."""
    shift = U64(64 - BUCKET_BITS)
    yield (hashes >> shift).astype(np.int32), first[:-1], first[1:]
    yield (windows(hashes, 2) >> shift).astype(np.int32), first[:-1], np.maximum(first[1:] - 1, first[:-1])
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(chars) < len(raw):
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    for width in (3, 4):
        yield char_grams(chars, width).astype(np.int32), at[:-1], np.maximum(at[1:] - width + 1, at[:-1])


@dataclass
class Linear:
    weights: np.ndarray  # families x buckets
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw_scores(self, raw, at, hashes, first) -> np.ndarray:
        total = np.full(len(at) - 1, self.bias)
        for k, (ids, lo, hi) in enumerate(families(raw, at, hashes, first)):
            sums = np.zeros(len(ids) + 1)
            np.cumsum(self.weights[k][ids], out=sums[1:])
            lo, hi = np.minimum(lo, len(ids)), np.minimum(hi, len(ids))
            total += (sums[hi] - sums[lo]) / np.maximum(hi - lo, 1)
        return total

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.shift, -30, 30)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, values = [], []
        for a, b, raw, at in blocks(batch.column(1), SMALL_BLOCK):
            hashes, first = word_hashes(raw, at)
            rows = [([], []) for _ in range(b - a)]
            for k, (grams, lo, hi) in enumerate(families(raw, at, hashes, first)):
                for r in range(b - a):
                    found, counts = np.unique(grams[lo[r]:hi[r]], return_counts=True)
                    rows[r][0].append(found + k * BUCKETS)
                    rows[r][1].append((counts / max(1, hi[r] - lo[r])).astype(np.float32))
            ids += [np.concatenate(x).astype("<i4").tobytes() for x, _ in rows]
            values += [np.concatenate(y).astype("<f4").tobytes() for _, y in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "label", "ids", "values"])


def labelled(documents: DataFrame, labels: DataFrame, column: str, sample: int) -> DataFrame:
    """doc_id, text, label for at most ``sample`` labelled documents, chosen by a hash of doc_id; of rows that repeat one, that whose text has the smallest hash."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    given = given.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.join(F.broadcast(given), "doc_id")  # at most ``sample`` rows are broadcast
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))


def fit(documents: DataFrame, labels: DataFrame, column: str, sample: int = SAMPLE, steps: int = 40, scale: float = 6.0) -> Linear | None:
    """Trains on four fifths of the sample and calibrates (Platt) on the rest; None without rows of both classes.

    Executors turn texts into sparse vectors; only those of the sample reach the driver.
    """
    rows = labelled(documents, labels, column, sample).mapInArrow(frugal(_featured), "doc_id long, label int, ids binary, values binary").toArrow().sort_by([("doc_id", "ascending")])
    y = np.array(rows.column("label").to_pylist(), float)
    if len(y) == 0 or y.min() == y.max():
        return None
    ids = [np.frombuffer(x, "<i4") for x in rows.column("ids").to_pylist()]
    values = [np.frombuffer(x, "<f4") for x in rows.column("values").to_pylist()]
    n = np.array([len(x) for x in ids])
    flat_ids, flat, row = np.concatenate(ids), np.concatenate(values), np.repeat(np.arange(len(n), dtype=np.int32), n)
    del rows, ids, values
    fold = np.arange(len(y)) % 5 == 4
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold[:] = False
    train = ~fold[row]

    # Values are scaled by each bucket's log-ratio between the classes, which conditions the fit.
    dims = FAMILIES * BUCKETS
    side = [np.bincount(flat_ids[train & (y[row] == c)], flat[train & (y[row] == c)], dims) for c in (0, 1)]
    share = [np.concatenate([(s + 1e-3) / (s + 1e-3).sum() for s in x.reshape(FAMILIES, BUCKETS)]) for x in side]
    ratio = np.log(share[1] / share[0])
    x = flat * ratio.astype(np.float32)[flat_ids]
    u, bias = np.ones(dims), 0.0
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y[~fold] == 1).sum()), 0.5 / max(1, (y[~fold] == 0).sum())) * ~fold
    for step in range(1, steps + 1):
        z = scale * np.bincount(row, x * u[flat_ids], len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = scale * np.bincount(flat_ids, x * error[row], dims) + 1e-4 * (u - 1) / max(1, len(y))
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
        u -= 0.05 * fix * m / (np.sqrt(v) + 1e-9)
        bias -= 0.05 * fix * mb / (np.sqrt(vb) + 1e-9)
    model = Linear((scale * u * ratio).reshape(FAMILIES, BUCKETS).astype(np.float32), float(bias))
    z = np.bincount(row, flat * model.weights.reshape(-1)[flat_ids], len(y)) + bias
    keep = fold if fold.any() else ~fold
    model.slope, model.shift = platt(z[keep], y[keep])
    return model


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (score, label), by Newton's method with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        ga, gb = ((p - t) * z).sum() + 1e-3 * a, (p - t).sum()
        haa, hab, hbb = (w * z * z).sum() + 1e-3, (w * z).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        big = max(1.0, abs(da), abs(db))
        a, b = a - da / big, b - db / big
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)
