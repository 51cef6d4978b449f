"""Structural chunks of markdown: heading paths, packed paragraphs, hard cuts at break points.

The rule carries state from line to line, so it runs in Python, on batches of documents.
Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

TARGET, LEAST, MOST = 1200, 200, 8000
HEADING = re.compile(r"^(#{1,6})[ \t]+(\S.*?)[ \t]*$")
BREAK_AFTER = set("\n。！？；：.!?;:、，,）)】」』]")


@dataclass
class Packer:
    text: str
    limit: int
    done: list[tuple[int, int, str]] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    path: str = ""

    def close(self) -> None:
        if self.spans:
            self.done.append((self.spans[0][0], self.spans[-1][1], self.path))
        self.spans = []

    def paragraph(self, start: int, end: int, path: str) -> None:
        if path != self.path:
            self.close()
        self.path = path
        held = sum(b - a for a, b in self.spans)
        if held and held + end - start > self.limit:
            self.close()
        while end - start > self.limit:
            cut = self.cut(start)
            self.close()
            self.spans = [(start, cut)]
            self.close()
            start = cut
        if end > start:
            self.spans.append((start, end))

    def cut(self, start: int) -> int:
        """Behind the last break character near the limit, else at the limit."""
        hard = start + self.limit
        for at in range(hard, max(start + 60, hard - self.limit // 6), -1):
            if self.text[at - 1] in BREAK_AFTER:
                return at
        return hard


def chunk(text: str | None, target: int = TARGET) -> list[dict]:
    """n, text, start, end and outline of each chunk; ``text[start:end]`` is the chunk."""
    text = text or ""
    packer, stack, opened, at = Packer(text, min(max(target, LEAST), MOST)), [], None, 0
    path = lambda: " / ".join(x for x in stack if x)
    for raw in [*text.split("\n"), None]:
        line = (raw or "").removesuffix("\r")
        heading = HEADING.match(line) if raw is not None else None
        if raw is None or heading or not line.strip():
            if opened:
                packer.paragraph(*opened, path())
                opened = None
        else:
            opened = (opened[0] if opened else at, at + len(line))
        if heading:
            packer.close()
            depth = len(heading[1])
            stack = [*stack[:depth - 1], *[""] * (depth - 1 - len(stack)), heading[2].strip()]
        at += len(raw or "") + 1
    packer.close()
    out = []
    for start, end, outline in packer.done:
        inner = text[start:end]
        lead = len(inner) - len(inner.lstrip())
        if inner.strip():
            out.append({"n": len(out) + 1, "text": inner.strip(), "start": start + lead, "end": start + lead + len(inner.strip()), "outline": outline})
    return out


def chunks(df: DataFrame, key: str, text: str, target: int = TARGET) -> DataFrame:
    """(key, n, text, start, end, outline), one row for each chunk."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k:k + 256]
                rows = [(i, c["n"], c["text"], c["start"], c["end"], c["outline"]) for i, t in zip(part[key], part[text], strict=True) for c in chunk(t, target)]
                yield pd.DataFrame(rows, columns=[key, "n", "text", "start", "end", "outline"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, n int, text string, start int, end int, outline string")
