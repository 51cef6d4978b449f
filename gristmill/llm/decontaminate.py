"""Benchmark decontamination: BM25 retrieval of test items for every training passage.

Items are indexed once per block of the benchmark.  A posting's weight is its BM25
weight divided by the item's score for its own words, so a passage that holds all of an
item scores 1 and one threshold serves items of every length.  Passages are windows of
words, overlapping by half, at least twice as long as the longest item that they are
compared with, so each copy lies whole in one; items are indexed by length, so a long one
does not widen the passages of the others.  Block-max WAND runs for all passages of a
block of text at once:

1. the sum of each term's largest weight bounds a passage's score with any item;
2. passages that pass get a bound for each block of items, from the block maxima;
3. only items of blocks that still pass are scored in full.

Each item's commonest terms, of which SLACK of its weight at most is made, have no
postings: what they could add is added to every bound instead.  So the words of which
every text is full are never looked up.

Bounds never undercut scores, so every item above the threshold is retrieved.  Hits are
then verified: the passage must hold most of the runs of words of the item's question
and of its answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import frugal, ship
from ._text import SMALL_BLOCK, U64, blocks, windows, word_hashes

K1, B = 1.2, 0.75
#: Share of an item's own score at which it is retrieved.
THRESHOLD = 0.5
#: Share of an item's weight that terms without postings may make up, the lightest first.
SLACK = 0.3
#: Shares of the question's and the answer's word runs that a passage must hold, and how long those runs are.
OVERLAP = 0.5
ANSWER_SHARE = 4  # the last quarter of an item's words counts as its answer
QUESTION_GRAM, ANSWER_GRAM = 3, 2
#: Items of fewer words say too little to be told from chance, and are left out: a test item ``the`` would meet every text.
LEAST_ITEM = 5
BLOCK_ITEMS = 16
#: Words in half a passage: as many as the longest item has, but no fewer than these.
LEAST_HALF = 32
#: Text of the test items that one index holds; a larger benchmark is taken in several passes over the corpus.
INDEX_BYTES = 16 << 20

#: ASCII punctuation separates words and case is folded; other bytes stay.
NORMAL = np.arange(256, dtype=np.uint8)
NORMAL[:128] = [ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(128)]


@dataclass
class Index:
    item_ids: list[int]
    terms: np.ndarray  # sorted hashes of the terms with postings
    seen: np.ndarray  # whether some such term begins with these 20 bits
    most: np.ndarray  # largest weight of each
    at: np.ndarray  # of each, its first row in the next two
    block: np.ndarray
    block_most: np.ndarray
    slack: float  # the largest weight of an item's terms without postings
    block_terms: list[np.ndarray]  # of each block, the hashes of all its terms
    block_weights: list[np.ndarray]  # and their weights, terms x items
    grams: list[tuple]  # of each item, for question and answer: hashes of its word runs and their width
    half: int  # half a passage, in words


SEEN_BITS = 20


def split_item(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = len(words) - max(1, len(words) // ANSWER_SHARE)
    return (words[:cut], words[cut:]) if cut else (words, words)


def _grams(words: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    width = min(width, len(words))
    return np.unique(windows(words, width)), width


def build(item_ids: list[int], words: list[np.ndarray], n_items: int, average: float, df: dict[int, int], longest: int) -> Index:
    """An index over some items, of at most ``longest`` words, with the statistics of all of them: number, mean length, document frequencies."""
    rows, slack = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))], 0.0
    for k, w in enumerate(words):
        terms, tf = np.unique(w, return_counts=True)
        n = np.array([df[int(t)] for t in terms])
        weight = np.log(1 + (n_items - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / average))
        weight = weight / weight.sum()
        order = np.argsort(weight, kind="stable")
        light = np.zeros(len(terms), bool)
        light[order[np.cumsum(weight[order]) <= SLACK]] = True
        slack = max(slack, float(weight[light].sum()))
        rows.append((terms, np.full(len(terms), k), weight, ~light))
    term, item, weight, listed = (np.concatenate([r[c] for r in rows]) for c in range(4))
    n_blocks = -(-len(words) // BLOCK_ITEMS)
    block_terms, block_weights = [], []
    for b in range(n_blocks):
        mine = item // BLOCK_ITEMS == b
        have, local = np.unique(term[mine], return_inverse=True)
        table = np.zeros((len(have), BLOCK_ITEMS))
        table[local, item[mine] % BLOCK_ITEMS] = weight[mine]
        block_terms.append(have)
        block_weights.append(table)
    terms, where = np.unique(term[listed], return_inverse=True)
    most = np.zeros(len(terms))
    np.maximum.at(most, where, weight[listed])
    pairs, place = np.unique(where.astype(np.int64) * max(1, n_blocks) + item[listed] // BLOCK_ITEMS, return_inverse=True)
    block_most = np.zeros(len(pairs))
    np.maximum.at(block_most, place, weight[listed])
    seen = np.zeros(1 << SEEN_BITS, bool)
    seen[(terms >> U64(64 - SEEN_BITS)).astype(np.int64)] = True
    at = np.searchsorted(pairs, np.arange(len(terms) + 1) * max(1, n_blocks))
    grams = [tuple(map(_grams, split_item(w), (QUESTION_GRAM, ANSWER_GRAM))) for w in words]
    return Index(item_ids, terms, seen, most, at, pairs % max(1, n_blocks), block_most, slack, block_terms, block_weights, grams, max(LEAST_HALF, longest))


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the range, member) for every member of the ranges lo..hi."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def search(index: Index, hashes: np.ndarray, first: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, float]]:
    """(document, first word of the passage, item, score) for all passages and items at or above the threshold."""
    if not len(index.terms) or not len(hashes):
        return
    maybe = np.flatnonzero(index.seen[(hashes >> U64(64 - SEEN_BITS)).astype(np.int64)])
    term = np.searchsorted(index.terms, hashes[maybe])
    term[term == len(index.terms)] = 0
    good = index.terms[term] == hashes[maybe]
    word, term = maybe[good], term[good]
    if not len(word):
        return
    needed = threshold - index.slack - 1e-9
    n_halves = -(-np.diff(first) // index.half)
    base = np.cumsum(n_halves) - n_halves
    doc = np.searchsorted(first, word, "right") - 1
    half = base[doc] + (word - first[doc]) // index.half
    key = np.unique(half * len(index.terms) + term)
    half, term = key // len(index.terms), key % len(index.terms)
    total = int(n_halves.sum())
    doc_of = np.repeat(np.arange(len(n_halves)), n_halves)
    # A passage is a half with the next one of its document.
    nexts = np.zeros(total, bool)
    nexts[:-1] = doc_of[1:] == doc_of[:-1]
    bound = np.bincount(half, index.most[term], total)
    passages = bound + np.where(nexts, np.append(bound[1:], 0), 0) >= needed
    wanted = passages.copy()
    wanted[1:] |= (passages & nexts)[:-1]
    keep = wanted[half]
    half, term = half[keep], term[keep]
    # Bounds of (half, block) from the block maxima, then of (passage, block).
    which, row = _expand(index.at[term], index.at[term + 1])
    n_blocks = len(index.block_terms)
    cells, place = np.unique(half[which] * n_blocks + index.block[row], return_inverse=True)
    sums = np.bincount(place, index.block_most[row], len(cells))
    of = cells // n_blocks
    own, prior = passages[of], (of > 0) & (passages & nexts)[np.maximum(of - 1, 0)]
    both, place = np.unique(np.concatenate([cells[own], cells[prior] - n_blocks]), return_inverse=True)
    limit = np.bincount(place, np.concatenate([sums[own], sums[prior]]), len(both))
    last, have = -1, None
    for cell in both[limit >= needed].tolist():
        passage, block = divmod(cell, n_blocks)
        d = int(doc_of[passage])
        start = int(first[d] + (passage - base[d]) * index.half)
        if passage != last:
            last, have = passage, np.unique(hashes[start:min(start + 2 * index.half, int(first[d + 1]))])
        mine = index.block_terms[block]
        at = np.searchsorted(mine, have)
        at[at == len(mine)] = 0
        scores = index.block_weights[block][at[mine[at] == have]].sum(axis=0)
        for k in np.flatnonzero(scores >= threshold).tolist():
            yield d, start, block * BLOCK_ITEMS + k, float(scores[k])


def overlaps(index: Index, item: int, passage: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and of the answer's word runs that the passage holds."""
    return tuple(float(np.isin(grams, windows(passage, width)).mean()) for grams, width in index.grams[item])


HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _hits(indexes: list[Index], column: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item id, score, overlaps) of verified hits, the best passage of each row and item."""
    for a, _, raw, at in blocks(column, SMALL_BLOCK):
        hashes, first = word_hashes(NORMAL[raw], at)
        best: dict[tuple[int, int], tuple] = {}
        for index in indexes:
            for doc, start, item, score in search(index, hashes, first):
                passage = hashes[start:min(start + 2 * index.half, first[doc + 1])]
                question, answer = overlaps(index, item, passage)
                if question >= OVERLAP and answer >= OVERLAP:
                    found, key = (score, question, answer), (doc, index.item_ids[item])
                    best[key] = max(best.get(key, found), found)
        for (doc, item), found in sorted(best.items()):
            yield a + doc, item, *found


def _scanned(indexes: list[Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_hits(indexes, batch.column(1)))
            if rows:
                picked = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([picked, *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds))], [c.split()[0] for c in HITS.split(", ")])

    return run


def _cleaned(indexes: list[Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[r[0] for r in _hits(indexes, batch.column("text"))]] = False
            yield batch.filter(pa.array(clean))

    return run


def item_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes(NORMAL[raw], np.array([0, len(raw)]))[0]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [item_words(x) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([len(r) for r in rows], pa.int64()), pa.array([np.unique(r).view(np.int64).tolist() for r in rows], pa.list_(pa.int64()))], ["n", "terms"])


def _by_length(item_ids: list[int], words: list[np.ndarray], n_items: int, average: float, df: dict[int, int]) -> list[Index]:
    """An index for each power of two of the items' lengths, from LEAST_HALF words on."""
    bound = [max(LEAST_HALF, 1 << (len(w) - 1).bit_length()) for w in words]
    return [build([i for i, b in zip(item_ids, bound, strict=True) if b == most], [w for w, b in zip(words, bound, strict=True) if b == most], n_items, average, df, most) for most in sorted(set(bound))]


def indexes(benchmark: DataFrame, most: int = INDEX_BYTES) -> Iterator[list[Index]]:
    """Indexes that together hold every item of LEAST_ITEM words or more, a list for each pass over the corpus.

    The size of the items is checked first: each pass takes a share of them, dealt out by
    a hash of id and text, of about ``most`` bytes, which bounds what the driver collects and
    executors hold.  Document frequencies and the mean length are those of all items.
    Null, empty and shorter items and those without an id are left out; rows that repeat
    an item are one, and texts under one id are each an item of that id.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(size / most))
    if parts > 1:
        terms = items.select("text").mapInArrow(_item_terms, "n long, terms array<long>").filter(F.col("n") >= LEAST_ITEM)
        totals = terms.agg(F.count("*").alias("k"), F.avg("n").alias("mean")).first()
        frequency = terms.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    for part in range(parts):
        rows = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        found = [(k, w) for k, t in sorted((r["item_id"], r["text"]) for r in rows.collect()) if len(w := item_words(t)) >= LEAST_ITEM]
        words = [w for _, w in found]
        if parts == 1:
            n, mean = len(words), sum(map(len, words)) / max(1, len(words))
            at, counts = np.unique(np.concatenate([np.unique(w) for w in words]) if words else np.zeros(0, U64), return_counts=True)
            df = dict(zip(at.tolist(), counts.tolist(), strict=True))
        else:
            n, mean = totals["k"], totals["mean"]
            here = rows.select("text").mapInArrow(_item_terms, "n long, terms array<long>").filter(F.col("n") >= LEAST_ITEM).select(F.explode("terms").alias("t")).distinct()
            df = {r["t"] % 2**64: r["df"] for r in frequency.join(here, "t", "left_semi").collect()}
        yield _by_length([k for k, _ in found], words, n, mean or 1.0, df)


def contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score and the two overlaps of every verified hit.

    One row for a document row and item, with the best passage; documents without hits
    have no row.  Null and empty texts have none.  Rows that repeat a doc_id are searched
    each; other columns are ignored.
    """
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for some in indexes(benchmark):
        found = docs.mapInArrow(frugal(_scanned(some)), HITS)
        out = found if out is None else out.unionByName(found)
    return out


def clean(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` without a hit, with all their columns.  Null and empty texts have none; repeated rows are looked at each."""
    ship(spark)
    for some in indexes(benchmark):
        documents = documents.mapInArrow(frugal(_cleaned(some)), documents.schema)
    return documents
