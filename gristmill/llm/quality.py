"""Quality rules: exact counts of each text, and a calibrated n-gram classifier for what the counts let through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _linear
from ._store import frugal, ship
from ._text import SMALL_BLOCK, U64, WHITE, blocks, mix, span_hashes, prefix_sums, windows, word_bounds

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # hundredths of the words
#: Probability of good quality under which a text is turned away.
THRESHOLD = 0.3
_BLANK = b" \t\n\r\x0b\x0c"


def _per_document(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])


def _repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, found = set(), 0
    for line in lines:
        if line not in seen:
            seen.add(line)
        elif line.strip(_BLANK):
            found += 1
    return found


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each document that lie in a window of eight words found more than once in it."""
    rows = len(first) - 1
    keys = windows(hashes, WINDOW)
    if not len(keys):
        return np.zeros(rows, np.int64)
    doc = np.repeat(np.arange(rows), np.diff(first))
    inside = doc[:len(keys)] == doc[WINDOW - 1:]
    where = np.flatnonzero(inside)
    keys = keys[where] ^ mix(doc[where].astype(U64) + U64(1))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(rows, np.int64)
    hit = where[np.isin(keys, twice)]
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + WINDOW, -1)
    return _per_document(np.cumsum(steps[:-1]) > 0, first)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def measures(column: pa.Array, model: _linear.Linear | None) -> list[pa.Array]:
    """The columns named in COLUMNS for every text; null counts as empty."""
    out: list[list[np.ndarray]] = [[] for _ in range(8)]
    for a, b, raw, at in blocks(column, SMALL_BLOCK):
        starts, ends, first = word_bounds(raw, at)
        hashes = span_hashes(prefix_sums(raw), starts, ends)
        n_words = np.diff(first)
        chars = _per_document(~WHITE[raw] & ((raw & 0xC0) != 0x80), at)
        repeated = _repeated_words(hashes, first)
        lines = np.array([_repeated_lines(raw[at[k]:at[k + 1]].tobytes()) for k in range(b - a)], np.int64)
        failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
        score = model.probabilities(model.raw_scores(raw, at, hashes, first)) if model else np.ones(b - a)
        for held, x in zip(out, (n_words, chars, _per_document(SYMBOLS[raw], at), lines, repeated, failed, ~failed & (score >= THRESHOLD), score), strict=True):
            held.append(x)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
    return [pa.array(np.concatenate(x), k) if x else pa.array([], k) for x, k in zip(out, kinds, strict=True)]


def _assessed(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *measures(batch.column(1), model)], ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    return run


def _filtered(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(measures(batch.column("text"), model)[6])

    return run


def fit(documents: DataFrame, labels: DataFrame, sample: int = _linear.SAMPLE) -> _linear.Linear | None:
    """The classifier; see _linear.fit.  Rows of ``labels`` with a null or another label are left out, and of several for a doc_id the larger label counts."""
    return _linear.fit(documents, labels, "quality", sample)


def assess(spark: SparkSession, documents: DataFrame, model: _linear.Linear | None) -> DataFrame:
    """doc_id and the columns of COLUMNS for every row of ``documents``.

    Empty, blank and null texts have no words and fail the base rules.  Without a model
    (no labelled rows of both classes) the base rules alone decide.  Rows are neither
    dropped nor merged, whatever their doc_id; other columns are ignored.
    """
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(frugal(_assessed(model)), "doc_id long, " + COLUMNS)


def accepted(spark: SparkSession, documents: DataFrame, model: _linear.Linear | None) -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns.

    Null, empty and blank texts fail the base rules and go; repeated rows are judged each,
    and other columns, whatever their names, are handed through.
    """
    ship(spark)
    return documents.mapInArrow(frugal(_filtered(model)), documents.schema)
