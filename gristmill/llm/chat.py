"""Chat formatting into prefix trees.

A conversation is a run of turns ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings
inside roles and texts are escaped by a backslash behind the ``<``, one more than there
are, which unescaping takes away again.  Conversations that share their first turns share
the tokens of those turns: a pack is a forest of turns written once each, depth first,
with a position for every token (that of its place in its own conversation) and, for
every turn, the intervals of earlier tokens that it may attend to: its ancestors'.

Conversations are dealt out by ranges of the hashes of their turns, so those that share
turns meet, with conv_id as a tie-breaker, so a beginning that a third of all
conversations share is still spread; packs are bounded, and one that is full is closed
and its shared turns are written again in the next.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch

START, END = "<|im_start|>", "<|im_end|>"
PACK_TOKENS = 1 << 16
PACK_CONVERSATIONS = 1 << 10

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Also keeps line feeds out, which end the role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class Vocabulary:
    """Byte-level ids, two more for the turn marks: their strings in a text are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start = max(ranks.values()) + 1
        self.end = self.start + 1

    def encode(self, text: str) -> list[int]:
        return self.inner.encode_ordinary(text)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids without turn marks."""
        return self.inner.decode_bytes(ids.tolist()).decode()

    def turn(self, role: str, text: str) -> tuple[np.ndarray, tuple[int, int]]:
        """(tokens, the part under the loss mask: an assistant's text)."""
        head, body = [self.start, *self.encode(escape_role(role) + "\n")], self.encode(escape(text))
        loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
        return np.array([*head, *body, self.end, *self.encode("\n")], np.int32), loss


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path, pattern)
    return _vocabularies[path]


class Pack:
    """A forest of turns; children in the order in which they come."""

    def __init__(self) -> None:
        self.children: list[dict[tuple[str, str], int]] = [{}]
        self.parent, self.turns, self.ends, self.size = [-1], [(np.zeros(0, np.int32), (0, 0))], [], 0

    def add(self, conv_id, turns: list[tuple[str, str]], words: Vocabulary) -> None:
        node = 0
        for turn in turns:
            then = self.children[node].get(turn)
            if then is None:
                then = len(self.parent)
                self.children[node][turn] = then
                self.children.append({})
                self.parent.append(node)
                self.turns.append(words.turn(*turn))
                self.size += len(self.turns[-1][0])
            node = then
        self.ends.append((conv_id, node))

    def row(self) -> dict:
        """Depth-first tokens, positions and loss flags; per turn its interval and its ancestors' intervals, neighbours joined."""
        tokens, number = [], {0: -1}
        spans, ancestors, depth, learnt, at = [], [], [], [], 0
        stack = list(reversed(self.children[0].values()))
        while stack:
            node = stack.pop()
            up = number[self.parent[node]]
            own, (a, b) = self.turns[node]
            before = [] if up < 0 else ancestors[up] + [spans[up]]
            if len(before) > 1 and before[-2][1] == before[-1][0]:
                before = [*before[:-2], (before[-2][0], before[-1][1])]
            number[node] = len(spans)
            spans.append((at, at + len(own)))
            learnt.append((at + a, at + b))
            ancestors.append(before)
            depth.append(0 if up < 0 else depth[up] + spans[up][1] - spans[up][0])
            tokens.append(own)
            at += len(own)
            stack += reversed(self.children[node].values())
        starts, ends = (np.array([s[k] for s in spans], np.int32) for k in (0, 1))
        loss = np.zeros(at, bool)
        for a, b in learnt:
            loss[a:b] = True
        return {
            "tokens": np.concatenate(tokens) if tokens else np.zeros(0, np.int32), "position_ids": np.arange(at, dtype=np.int32) + np.repeat(np.array(depth, np.int32) - starts, ends - starts), "loss": loss,
            "turn_start": starts, "turn_end": ends, "attends": [[{"start": s, "end": e} for s, e in x] for x in ancestors],
            "conv_ids": [c for c, _ in self.ends], "last_turn": [number[n] for _, n in self.ends],
        }

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for f, x in zip(_PACK_SCHEMA, self.row().values(), strict=True)], schema=_PACK_SCHEMA)


PACKED = "tokens array<int>, position_ids array<int>, loss array<boolean>, turn_start array<int>, turn_end array<int>, attends array<array<struct<start:int,end:int>>>, conv_ids array<long>, last_turn array<int>"
_INTERVALS = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
_PACK_SCHEMA = pa.schema([
    ("tokens", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("turn_start", pa.list_(pa.int32())), ("turn_end", pa.list_(pa.int32())),
    ("attends", _INTERVALS), ("conv_ids", pa.list_(pa.int64())), ("last_turn", pa.list_(pa.int32())),
])


def _packed(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = vocabulary(path, pattern), Pack()
        for batch in batches:
            for k in range(batch.num_rows):
                turns = [(t["role"], t["text"]) for t in batch.column("turns")[k].as_py()]
                pack.add(batch.column("conv_id")[k].as_py(), turns, words)
                if pack.size >= PACK_TOKENS or len(pack.ends) >= PACK_CONVERSATIONS:
                    yield pack.batch()
                    pack = Pack()
        if pack.ends:
            yield pack.batch()

    return run


def format_conversations(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """Packs, with the columns of PACKED.

    Rows of one conv_id are one conversation, by turn, then role and text where a turn
    repeats; null roles and texts count as empty, and each row without a conv_id is a
    conversation of its own.  A conversation is the unit of work: its turns are read in
    order and so meet in one task.  Other columns are ignored.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    whole = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = whole.unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    path_of = F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0")), "")
    dealt = whole.withColumn("path", path_of).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return dealt.select("conv_id", "turns").mapInArrow(_packed(path, pattern), PACKED)


def read_pack(row: dict, words: Vocabulary) -> Iterator[tuple]:
    """(conv_id, formatted text, [(role, text)], texts under the loss mask) of every conversation, from the tokens and intervals alone."""
    for conv, last in zip(row["conv_ids"], row["last_turn"], strict=True):
        spans = [] if last < 0 else [(x["start"], x["end"]) for x in row["attends"][last]] + [(int(row["turn_start"][last]), int(row["turn_end"][last]))]
        ids, flags = (np.concatenate([row[c][a:b] for a, b in spans]) if spans else np.zeros(0, row[c].dtype) for c in ("tokens", "loss"))
        turns, learnt, whole = [], [], []
        starts, ends = np.flatnonzero(ids == words.start).tolist(), np.flatnonzero(ids == words.end).tolist()
        for a, b, then in zip(starts, ends, [*starts[1:], len(ids)], strict=True):
            part = words.decode(ids[a + 1:b])
            role, _, text = part.partition("\n")
            turns.append((unescape_role(role), unescape(text)))
            whole += [START, part, END, words.decode(ids[b + 1:then])]
            marked = ids[a:b][flags[a:b]]
            if len(marked):
                learnt.append(unescape(words.decode(marked)))
        yield conv, "".join(whole), turns, learnt


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].values.to_numpy(zero_copy_only=False) if name in ("tokens", "loss", "turn_start", "turn_end") else batch.column(name)[k].as_py() for name in batch.schema.names if name != "position_ids"}
                out = []
                for conv, text, turns, learnt in read_pack(row, words):
                    loss = "".join(learnt)
                    told = "".join(f"{role}\n{said}\n" for role, said in turns)
                    out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], [c.split()[0] for c in DIGESTS.split(", ")])

    return run


def round_trip(spark: SparkSession, conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """Writes the packs and reads every conversation back from them; columns of DIGESTS."""
    packs = Scratch(spark, "chat").table(format_conversations(conversations, path, pattern), "packs")
    return packs.mapInArrow(_digested(path, pattern), DIGESTS)
