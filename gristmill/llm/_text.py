"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes outside \\x20 and \\x09-\\x0D, so they can be found
on UTF-8 bytes without decoding.  Every helper works on blocks of whole documents,
which keeps numpy's temporaries within a few dozen MB whatever the batch size; only
a single document larger than a block makes a block larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20
#: Blocks of functions whose temporaries are many times the text.
SMALL_BLOCK = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_MUL = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_MUL), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3; a bijection."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        row = np.full(size, _MUL if kind == "up" else _INV, U64)
        row[0] = 1
        have = np.multiply.accumulate(row)
        if size <= 4 * BLOCK_BYTES:
            _powers[kind] = have
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of length rows + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole documents of about ``most`` bytes."""
    raw, at = text_buffers(column)
    rows, a = len(at) - 1, 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        b = min(b, rows)
        yield a, b, raw[at[a]:at[b]], at[a:b + 1] - at[a]
        a = b


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) in a block."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    white = WHITE[raw]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = white[:-1]
    edges = at[(at > 0) & (at < n)]
    before[edges] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = white[1:]
    after[edges - 1] = True
    inside = ~white
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[raw] * _power("up", len(raw)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, independent of where they lie."""
    if not len(starts):
        return np.zeros(0, U64)
    raw = (sums[ends] - sums[starts]) * _power("down", len(sums))[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, first word of each document and the total)."""
    starts, ends, first = word_bounds(raw, at)
    return span_hashes(prefix_sums(raw), starts, ends), first


def hash_words(words: list[str]) -> np.ndarray:
    """The same hashes for a list of words."""
    return np.array([word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0] for w in words], U64)


_COEF = [U64(c) for c in (0x9AE16A3B2F90404F, 0xC949C7DEFE5A3C21, 0xB492B66FBE98F273, 0x8648DBBC94D49B8D, 0xA2F33E4E3B5BC3C9, 0xE95E1DD17D35801B, 0xD8B7B3F6D2F1E4A7, 0xF1D3A6C8B4E59263)]


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words (callers drop those across documents)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for k in range(width):
        total += words[k:k + n] * _COEF[k]
    return mix(total ^ U64(width))
