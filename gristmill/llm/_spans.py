"""Shared by the operators that report spans of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa

#: (start, place of the kind in the list of kinds, end); code points, end exclusive.
Span = tuple[int, int, int]


def joined(spans: list[Span], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{start}:{end}" for start, k, end in sorted(spans))


def apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``spans`` that overlap none of ``base``."""
    out, taken, k = [], sorted((s, e) for s, _, e in base), 0
    ends = 0
    for span in sorted(spans):
        while k < len(taken) and taken[k][0] < span[2]:
            ends = max(ends, taken[k][1])
            k += 1
        if ends <= span[0]:
            out.append(span)
    return out


def columns(names: list[str]) -> str:
    return ", ".join(["doc_id long", *(f"n_{n} long" for n in names), "base_sha256 string", "spans string"])


def scan(base: Callable[[str], list[Span]], more: Callable[[list[str], list[list[Span]]], list[list[Span]]], kinds: list[str], counted: int):
    """For mapInArrow over (doc_id, text): counts of the first ``counted`` kinds in the base spans, their digest, and all spans.

    ``more`` gets a run of texts with their base spans and returns the spans to add.
    """
    names = [c.split()[0] for c in columns(kinds[:counted]).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                texts, size = [], 0
                while first + len(texts) < batch.num_rows and size < 1 << 21:
                    texts.append(batch.column(1)[first + len(texts)].as_py() or "")
                    size += len(texts[-1])
                found = [base(t) for t in texts]
                added = more(texts, found)
                rows = []
                for b, a in zip(found, added, strict=True):
                    rows.append([*(sum(s[1] == k for s in b) for k in range(counted)), hashlib.sha256(joined(b, kinds).encode()).hexdigest(), joined(b + apart(a, b), kinds)])
                types = [pa.int64()] * counted + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)
                first += len(texts)

    return run
