"""Token ids in canonical, length-limited Huffman code, written and read in independent blocks.

File format (one frame per row of a Parquet container, so that Spark's commit protocol
covers lost executors and every store that Spark reaches can hold it): a frame has the
ids of a run of documents in doc_id order as one bit stream of prefix codes, most
significant bit first, plus the bit offset of every 1,024th id.  The codebook is a
second table with the code length of every id; canonical codes follow from the lengths
alone.  A reader decodes all blocks of a frame in step, one table lookup a symbol.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import U64, blocks, prefix_sums, span_hashes, word_bounds

LONGEST_CODE = 16
BLOCK_IDS = 1024
FRAME_IDS = 1 << 20
FRAME_DOCS = 1 << 14
#: Distinct words that each of a cache's two generations holds.
CACHED_WORDS = 600_000
LEARNT_WORDS = 4096


# --- words to ids -----------------------------------------------------------

#: The splitter and the normalisers for which words are prepared here, and the string inside every added token.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
MARK = "<|"

_LETTER, _DIGIT, _OTHER, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[[ord("'"), 0x20]] = _ODD, 0
_KIND[ord("0"):ord("9") + 1] = _DIGIT
_KIND[[*range(ord("a"), ord("z") + 1), 0xC3]] = _LETTER  # 0xC3 leads the letters from U+00C0 to U+00FF
#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on; the space is kept to part words.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = np.arange(256).astype("<u2")
_ALPHABET[[b for b in range(256) if b not in _PRINTABLE]] = 0x100 + np.arange(256 - len(_PRINTABLE))
_ALPHABET[0x20] = 0x20


def prepared(raw: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """What the tokenizer's normalisers and splitter make of words, in bulk.

    ``raw`` holds the bytes of words, each with a space behind it, at ``ends``.  Returns
    the pieces of all plain words in the byte-level alphabet, parted by spaces; which
    words are plain; and how many pieces each plain one has.  Plain words hold ASCII and
    letters up to U+00FF only, no apostrophe and no mark of an added token: composing
    leaves them alone, case is folded by adding 32, and pieces are runs of letters, single
    digits and runs of the rest.
    """
    raw = raw.copy()
    raw[(raw >= ord("A")) & (raw <= ord("Z"))] += 32
    kind = _KIND[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    value = raw[second]
    sign = (value == 0x97) | (value == 0xB7)
    raw[second] += np.where((value <= 0x9E) & ~sign, 32, 0).astype(np.uint8)
    kind[second] = np.where(sign, _ODD, _LETTER)
    kind[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = _ODD
    plain = np.ones(len(ends), bool)
    plain[np.searchsorted(ends, np.flatnonzero(kind == _ODD))] = False
    cut = (kind[:-1] != kind[1:]) | (kind[1:] == _DIGIT)
    cut &= (kind[:-1] > 0) & (kind[1:] > 0)
    before = np.concatenate([[0], np.cumsum(cut)])
    out = np.full(len(raw) + int(before[-1]), 0x20, "<u2")
    out[np.arange(len(raw)) + before] = np.where(np.repeat(plain, np.diff(ends, prepend=-1)), _ALPHABET[raw], 0x20)
    pieces = np.diff(before[ends], prepend=0) + 1
    return out.tobytes().decode("utf-16-le"), plain, pieces[plain]


class IdTable:
    """A hash table from 64-bit word hashes to runs of ids, in arrays; two of the words that one holds agree with a probability of 1e-8."""

    def __init__(self, bits: int = 21) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.key, self.start, self.size = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.pool, self.used, self.count = np.zeros(1 << 20, "<u2"), 0, 0

    def with_room(self, n: int) -> IdTable:
        """This table, or a larger one of the same content, in which ``n`` more words leave half the slots free."""
        bits = max(self.bits, (2 * (self.count + n)).bit_length())
        if bits == self.bits:
            return self
        out, held = IdTable(bits), np.flatnonzero(self.key)
        out.add(self.key[held], *self.ids(held))
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where there is none."""
        out, at, todo = np.full(len(hashes), -1, np.int64), (hashes >> U64(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            held = self.key[at[todo]]
            hit = held == hashes[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (held != 0)]
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slots in order, how many each has)."""
        sizes = self.size[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[slots] - ends + sizes, sizes)], sizes

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Enters distinct hashes that are not there yet."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), "<u2")])
        start = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used:self.used + len(ids)] = ids
        at, todo = (hashes >> U64(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = self.key[at[todo]] == 0
            some = todo[free]
            self.key[at[some]] = hashes[some]  # of several for one slot, the last stays
            todo = todo[self.key[at[todo]] != hashes[todo]]
            at[todo] = (at[todo] + 1) & self.mask
        self.start[at], self.size[at] = start, sizes
        self.used, self.count = self.used + len(ids), self.count + len(hashes)


class WordEncoder:
    """Ids of texts by the tokenizers library, which is asked once for every word that the cache does not hold.

    The vocabulary's normaliser and splitter never look across white space, so a text's
    ids are those of its white-space separated words in order.  Plain words are normalised
    and split in bulk (see ``prepared``) and go to the library's model by the thousand, in
    one text; the last id of a piece carries the end-of-word mark, which parts them again.
    All others, and all words of a tokenizer with other rules, go through the whole
    tokenizer.  The cache has two generations: a full one becomes the older, from which
    words still in use are taken over, and the one before is dropped.  Ids are kept as
    little-endian 16-bit numbers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner, self.bare, self.known, self.older = Tokenizer.from_file(path), None, IdTable(), IdTable()
        if self.inner.get_vocab_size() > 1 << 16:
            raise ValueError("ids over 65,535 need another width")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}])
        mark = model.get("end_of_word_suffix")
        alike = (spec["normalizer"] or {}).get("normalizers") == NORMALISERS and steps[0].get("pattern") == {"Regex": SPLITTER} and steps[1].get("type") == "ByteLevel"
        if alike and mark and model["type"] == "BPE" and all(MARK in t["content"] for t in spec["added_tokens"]):
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            self.last = np.zeros(1 << 16, bool)
            self.last[[k for piece, k in model["vocab"].items() if piece.endswith(mark)]] = True

    def encode_block(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block in order, where each text's begin, and the total)."""
        starts, ends, first = word_bounds(raw, at)
        hashes = np.maximum(span_hashes(prefix_sums(raw), starts, ends), U64(1))
        if self.known.count > CACHED_WORDS:
            self.known, self.older = IdTable(), self.known
        slots = self.known.find(hashes)
        lacking = np.flatnonzero(slots < 0)
        if len(lacking):
            new, where = np.unique(hashes[lacking], return_index=True)
            self.known = self.known.with_room(len(new))
            old = self.older.find(new)
            self.known.add(new[old >= 0], *self.older.ids(old[old >= 0]))
            new, where = new[old < 0], lacking[where[old < 0]]
            for k in range(0, len(new), LEARNT_WORDS):
                self._learn(raw, starts[where[k:k + LEARNT_WORDS]], ends[where[k:k + LEARNT_WORDS]], new[k:k + LEARNT_WORDS])
            slots = self.known.find(hashes)
        ids, sizes = self.known.ids(slots)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        size = ends - starts + 1
        stops = np.cumsum(size)
        words = raw[np.minimum(np.arange(int(stops[-1])) + np.repeat(starts - stops + size, size), len(raw) - 1)]
        words[stops - 1] = 0x20
        odd = np.ones(len(starts), bool)
        if self.bare:
            text, plain, pieces = prepared(words, stops - 1)
            odd = ~plain
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
            marks = np.flatnonzero(self.last[ids]) + 1
            if len(marks) != pieces.sum():
                raise RuntimeError("pieces and ids disagree")
            self.known.add(hashes[plain], ids, np.diff(marks[np.cumsum(pieces) - 1], prepend=0))
        if odd.any():
            rest = [words[a:b].tobytes().decode("utf-8", "replace") for a, b in zip((stops - size)[odd].tolist(), (stops - 1)[odd].tolist(), strict=True)]
            found = [np.array(x.ids, "<u2") for x in self.inner.encode_batch_fast(rest, add_special_tokens=False)]
            self.known.add(hashes[odd], np.concatenate(found), np.array([len(x) for x in found]))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _ids(column: pa.Array, path: str, end: int) -> Iterator[bytes]:
    tail, one = np.array([end], "<u2").tobytes(), encoder(path)
    for _, _, raw, at in blocks(column):
        ids, cuts = one.encode_block(raw, at)
        data, cuts = ids.tobytes(), (2 * cuts).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield data[a:b] + tail


# --- codes ------------------------------------------------------------------

def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << longest:
        raise ValueError("too many symbols for codes of this length")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        every = np.concatenate([coins, packages])
        rank = np.argsort(every, kind="stable")
        levels.append(rank < len(coins))
        merged = every[rank]
        pairs = len(merged) // 2 * 2
        packages = merged[0:pairs:2] + merged[1:pairs:2]
    take = 2 * len(coins) - 2
    for single in reversed(levels):
        singles = int(single[:take].sum())
        lengths[order[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        code <<= 1
        ids = np.flatnonzero(lengths == size)
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray, longest: int = LONGEST_CODE) -> tuple[np.ndarray, np.ndarray]:
    """(id, code length) for every value of the next ``longest`` bits."""
    codes = canonical_codes(lengths)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spans = 1 << (longest - lengths[ids].astype(np.int64))
    symbols, sizes = np.zeros(1 << longest, np.uint16), np.ones(1 << longest, np.uint8)
    total = int(spans.sum())
    symbols[:total], sizes[:total] = np.repeat(ids, spans), np.repeat(lengths[ids], spans)
    assert not len(ids) or int(codes[ids[0]]) == 0
    return symbols, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bit stream, bit offset of every BLOCK_IDS-th id)."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    offsets = ends - size
    word, room = offsets >> 6, 64 - (offsets & 63) - size
    value = codes[ids]
    over = room < 0
    first = np.where(over, value >> np.where(over, -room, 0).astype(np.uint64), value << np.where(over, 0, room).astype(np.uint64))
    out = np.zeros(int((ends[-1] + 63) >> 6), np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[starts]] = np.add.reduceat(first, starts)
    spill = np.flatnonzero(over)
    out[word[spill] + 1] += value[spill] << (64 + room[spill]).astype(np.uint64)
    return out.astype(">u8").tobytes(), offsets[::BLOCK_IDS]


def unpack(stream: bytes, checkpoints: np.ndarray, n_ids: int, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of a stream; all blocks advance together."""
    if not n_ids:
        return np.zeros(0, np.uint16)
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    ahead = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = np.array(checkpoints, np.int64)
    out = np.zeros((BLOCK_IDS, len(at)), np.uint16)
    whole, rest = n_ids // BLOCK_IDS, n_ids % BLOCK_IDS
    for k in range(BLOCK_IDS if whole else rest):
        if k == rest and whole < len(at):
            at = at[:whole]
        bits = (ahead[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[k, :len(at)] = symbols[bits]
        at = at + sizes[bits]
    return out.T.reshape(-1)[:n_ids]


# --- tables -----------------------------------------------------------------

FRAME = "part int, seq int, start long, n_ids long, doc_ids array<long>, sizes array<int>, checkpoints array<long>, stream binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
_NAMES = [f.split()[0] for f in FRAME.split(", ")]


def _tokenised(path: str, end: int):
    """Frames whose stream is still plain 16-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq = start = size = 0
        held, docs = [], []

        def frame() -> pa.RecordBatch:
            one = [[part], [seq], [start], [size], [docs], [[len(h) // 2 for h in held]], [[]], [b"".join(held)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, _KINDS, strict=True)], _NAMES)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(1), path, end), strict=True):
                held.append(ids)
                docs.append(doc)
                size += len(ids) // 2
                if size >= FRAME_IDS or len(docs) >= FRAME_DOCS:
                    yield frame()
                    seq, start, size, held, docs = seq + 1, start + size, 0, [], []
        if docs:
            yield frame()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for stream in batch.column(0):
            total += np.bincount(np.frombuffer(stream.as_buffer(), "<u2"), minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["id", "n"])


def _coded(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                stream, checkpoints = pack(np.frombuffer(batch.column("stream")[k].as_buffer(), "<u2"), codes, lengths)
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns[:6], pa.array([checkpoints], _KINDS[6]), pa.array([stream], _KINDS[7])], _NAMES)

    return run


def write(spark: SparkSession, documents: DataFrame, path: str, scratch: Scratch, end: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Writes frames and codebook under ``scratch``; returns (frames, code lengths).

    Texts are dealt out by ranges of doc_id, a hash of the text parting rows that repeat
    one doc_id, and tokenised once, into an intermediate table of plain ids.  Counts come
    from all of them, and at most one count per id of the vocabulary reaches the driver.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = docs.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    plain = scratch.table(dealt.mapInArrow(_tokenised(path, end), FRAME), "plain", compression="zstd")
    counts = np.zeros(1 << 16, np.int64)
    for row in plain.select("stream").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths).tolist()
    scratch.table(spark.createDataFrame([(k, int(lengths[k])) for k in used], "id int, bits int").coalesce(1), "codebook")
    frames = scratch.table(plain.mapInArrow(_coded(lengths), FRAME), "frames", compression="none")
    scratch.drop("plain")
    return frames, lengths


def _read(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, sizes = decode_table(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                one = {name: batch.column(name)[k] for name in batch.schema.names}
                n = one["sizes"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = unpack(one["stream"].as_py(), one["checkpoints"].values.to_numpy(zero_copy_only=False), one["n_ids"].as_py(), symbols, sizes).astype("<u4")
                ends = np.cumsum(n)
                view = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                crcs = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["part"].as_py()] * len(n), pa.int32()), one["doc_ids"].values, pa.array(one["start"].as_py() + ends - n), pa.array(n), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_digests(frames: DataFrame, lengths: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, decoded from the files."""
    totals = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task that wrote
    rows = frames.mapInArrow(_read(lengths), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def store(spark: SparkSession, documents: DataFrame, path: str, end: int = 1) -> DataFrame:
    """Writes the ids of all texts, each followed by ``end``, and reads them back.

    Null and empty texts have the end id alone.  Rows without a doc_id come first; rows
    that repeat a doc_id follow each other.  An empty table gives no rows, and other
    columns are ignored.
    """
    frames, lengths = write(spark, documents, path, Scratch(spark, "tokens"), end)
    return read_digests(frames, lengths)
