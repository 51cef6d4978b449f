"""SentencePiece encoding and decoding for byte-pair models with byte fallback.

An Aho-Corasick automaton over the pieces reads each chunk once; at every position the
output links give the pieces that end there, and a Viterbi step keeps the one whose
predecessor is right.  For a byte-pair model the best path is not the one with the
highest sum of scores but the one that the merge order yields, so a step's score is
whether a piece may follow the last piece of the best path before it: whether merging
the two pieces' text by rank gives just those two.  A path all of whose neighbours
agree is the model's encoding, and there is one such path to every position.

Pieces hold the space mark only at their beginning and never a line feed, so texts are
cut there into chunks, and the ids of each distinct chunk are computed once per worker.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import frugal

SPACE = "▁"
#: Distinct chunks that each of a cache's two generations holds.
CACHED_CHUNKS = 300_000
CACHED_PAIRS = 1_000_000


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        inner = sentencepiece.SentencePieceProcessor(model_file=path)
        size = inner.get_piece_size()
        self.pieces = [inner.id_to_piece(k) for k in range(size)]
        plain = [k for k in range(size) if not (inner.is_control(k) or inner.is_unknown(k) or inner.is_byte(k) or inner.is_unused(k))]
        self.ids = {self.pieces[k]: k for k in plain}
        self.score = {self.pieces[k]: inner.get_score(k) for k in plain}
        self.byte_ids = {int(self.pieces[k][3:5], 16): k for k in range(size) if inner.is_byte(k)}
        self.unknown = inner.unk_id()
        self.chars = {c for p in self.ids for c in p}
        self.joints = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        inner_space = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        ends = "\n" if "\n" not in self.chars else ""
        self.chunk = re.compile("(?s).+" if inner_space else f"{SPACE}+[^{SPACE}{ends}]*|[^{SPACE}{ends}]+" + (f"|{ends}+" if ends else ""))
        self.raw = [bytes([int(p[3:5], 16)]) if inner.is_byte(k) else b"" if inner.is_control(k) else " ⁇ ".encode() if inner.is_unknown(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self._automaton()

    def _automaton(self) -> None:
        """Transitions per state, fail links, and the pieces that end in a state, longest first, by output links."""
        goto, fail, ends = [{}], [0], [None]
        for piece, k in self.ids.items():
            state = 0
            for c in piece:
                then = goto[state].get(c)
                if then is None:
                    then = len(goto)
                    goto[state][c] = then
                    goto.append({})
                    fail.append(0)
                    ends.append(None)
                state = then
            ends[state] = (k, len(piece))
        out: list[tuple] = [()] * len(goto)
        queue = deque(goto[0].values())
        out_of = lambda s: ((ends[s],) if ends[s] else ()) + out[fail[s]]
        for s in goto[0].values():
            out[s] = out_of(s)
        while queue:
            state = queue.popleft()
            for c, then in goto[state].items():
                back = fail[state]
                while back and c not in goto[back]:
                    back = fail[back]
                fail[then] = goto[back].get(c, 0) if goto[back].get(c, 0) != then else 0
                out[then] = out_of(then)
                queue.append(then)
        self.goto, self.fail, self.out = goto, fail, out

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-ranked neighbours first, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        key = left * 1_000_003 + right
        found = self.pairs.get(key)
        if found is None:
            a, b = self.pieces[left] if left >= 0 else "", self.pieces[right]
            found = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _known_run(self, text: str) -> list[int]:
        goto, fail, out, pairs, n = self.goto, self.fail, self.out, self.pairs, len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        reached = [False] * (n + 1)
        reached[0] = True
        state = 0
        for at in range(n):
            c = text[at]
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            end = at + 1
            for k, length in out[state]:
                start = end - length
                if not reached[start]:
                    continue
                left = last[start]
                good = pairs.get(left * 1_000_003 + k)
                if good is None:
                    good = self.follows(left, k)
                if good:
                    last[end], size[end], reached[end] = k, length, True
                    break
        if not reached[n]:
            return [self.ids[p] for p in self.merged(text)]
        found, at = [], n
        while at:
            found.append(last[at])
            at -= size[at]
        return found[::-1]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids as little-endian 32-bit numbers; characters outside the model become their bytes."""
        ids: list[int] = []
        held = ""
        if self.chars.issuperset(chunk):
            ids = self._known_run(chunk)
        else:
            for c in [*chunk, ""]:
                if c and c in self.chars:
                    held += c
                    continue
                if held:
                    ids += self._known_run(held)
                    held = ""
                ids += [self.byte_ids.get(b, self.unknown) for b in c.encode()]
        return np.array(ids, "<u4").tobytes()

    def _punctuated(self, chunk: str) -> bytes:
        """No merge crosses two characters that stand together in no piece, so a chunk that ends in such a pair is taken in two parts."""
        if len(chunk) > 2 and chunk[-2:] not in self.joints:
            core, tail = chunk[:-1], chunk[-1]
            for x in (core, tail):
                if x not in self.known:
                    self.known[x] = self.older.get(x) or self.encode_chunk(x)
            return self.known[core] + self.known[tail]
        return self.encode_chunk(chunk)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = self.chunk.findall(SPACE + text.replace(" ", SPACE))
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            pass
        if len(self.known) > CACHED_CHUNKS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for c in chunks:
            if c not in known:
                known[c] = older.get(c) or self._punctuated(c)
        return b"".join(map(known.__getitem__, chunks))

    def decode(self, ids: np.ndarray) -> str:
        raw, table = b"", self.raw
        raw = b"".join([table[k] for k in ids.tolist()])
        return raw.decode("utf-8", "replace").removeprefix(" ")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path)
        for batch in batches:
            sizes, crcs, sums, same = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                raw = one.encode(text)
                back = one.decode(np.frombuffer(raw, "<u4"))
                sizes.append(len(raw) // 4)
                crcs.append(zlib.crc32(raw))
                sums.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(sums, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "text_sha256", "round_trip"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path)
        for batch in batches:
            held, first, size = [], 0, 0
            for k, value in enumerate(batch.column(1)):
                held.append(one.encode(value.as_py() or ""))
                size += len(held[-1])
                if size > 1 << 22 or k + 1 == batch.num_rows:
                    at = np.cumsum([0, *(len(h) // 4 for h in held)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(held), "<i4")))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(np.diff(at).astype(np.int64)), ids], ["doc_id", "n_tokens", "ids"])
                    held, first, size = [], k + 1, 0

    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int>: the model's ids of every whole text.

    Null and empty texts have no ids.  Rows are neither dropped nor merged, whatever
    their doc_id; other columns are ignored.
    """
    return _texts(documents).mapInArrow(frugal(_encoded(path)), "doc_id long, n_tokens long, ids array<int>")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), text_sha256 (of the decoded text), round_trip.

    Decoding turns the space mark U+2581 into a space, so texts that hold that character
    do not come back unchanged.
    """
    return _texts(documents).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_crc32 long, text_sha256 string, round_trip boolean")
