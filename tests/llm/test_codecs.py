import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import chat, queries, sentencepiece_codec, token_store

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "  a  b\nc\tx ", "▁x", "<s> </s> <0x41>", "日本語 🙂🙂 zalgo é", "\x00\r\n", "a" * 3000, " " * 500, "don't 'S <|endoftext|> ÀÉ  x y"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_pieces_as_the_library_has_them(library, text):
    ids = np.frombuffer(sentencepiece_codec.codec(PIECES).encode(text), "<u4")
    assert ids.tolist() == library.encode(text) and sentencepiece_codec.codec(PIECES).decode(ids) == library.decode(ids.tolist())


def test_pieces_over_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    found = {r["doc_id"]: r["ids"] for r in sentencepiece_codec.encode(docs, PIECES).collect()}
    assert found == {r["doc_id"]: library.encode(r["text"]) for r in rows}
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ODD)], "doc_id long, text string, ids int")
    for r in sentencepiece_codec.digests(df, PIECES).collect():
        text = ODD[r["doc_id"]] or ""
        ids = library.encode(text)
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r["round_trip"] == ("▁" not in text) and r["text_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode(spark.createDataFrame([], "doc_id long, text string"), PIECES).collect() == []


def test_code_lengths():
    rng = np.random.default_rng(3)
    for n in (2, 3, 50, 3000):
        counts = (rng.pareto(0.4, n) * 5).astype(np.int64) + 1
        lengths = token_store.code_lengths(counts, 12)
        assert lengths.max() <= 12 and sum(2.0 ** -int(x) for x in lengths) == 1
        if n <= 50:  # unbounded lengths are Huffman's
            import heapq

            heap, cost = counts.tolist(), 0
            heapq.heapify(heap)
            while len(heap) > 1:
                a = heapq.heappop(heap) + heapq.heappop(heap)
                cost += a
                heapq.heappush(heap, a)
            assert int((token_store.code_lengths(counts, 40) * counts).sum()) == cost
    assert token_store.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        token_store.code_lengths(np.ones(5, np.int64), 2)


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_pack_and_unpack(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 4000).astype(np.uint16)
    lengths = token_store.code_lengths(np.bincount(ids, minlength=65536) if n else np.zeros(65536, np.int64))
    stream, at = token_store.pack(ids, token_store.canonical_codes(lengths), lengths)
    assert (token_store.unpack(stream, at, n, *token_store.decode_table(lengths)) == ids).all()


def library_ids(texts):
    from tokenizers import Tokenizer

    return [[*x.ids, 1] for x in Tokenizer.from_file(WORDS).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def encoded(texts):
    return [np.frombuffer(x, "<u2").tolist() for x in token_store._ids(pa.array(texts, pa.string()), WORDS, 1)]


def test_ids_equal_the_librarys_on_all_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    assert encoded(texts) == library_ids(texts)


def test_ids_equal_the_librarys_on_odd_texts():
    rng = random.Random(4)
    signs = "aAzZ09.,'<|>\\\u00c0\u00c9\u00df\u00ff\u00f7\u00d7\u00e9n\u0301\u00a0\u2028\u0130\u03a3\u03c2\u4e2d\u0915\u094d\u200d\x00\x1c\x85\t \n-_#\U0001f642\u01c5\ufb01\u2019st"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += ["<|startoftext|>", "<|endoftext|>x", "A<|endoftext|>", "don't DON'T 'S 's'tx", None, "", "x" * 100_000]
    assert encoded(texts) == library_ids(texts)


def test_a_small_cache_turns_over_and_a_table_grows(monkeypatch):
    monkeypatch.setattr(token_store, "CACHED_WORDS", 50)
    monkeypatch.setattr(token_store, "LEARNT_WORDS", 7)
    monkeypatch.setattr(token_store, "_encoders", {})
    one = token_store.encoder(WORDS)
    one.known, one.older = token_store.IdTable(3), token_store.IdTable(3)
    texts = [f"the word{k % 300} of {k * 7919 % 1000} things" for k in range(1500)]
    for k in range(0, 1500, 100):
        assert encoded(texts[k:k + 100]) == library_ids(texts[k:k + 100])


def test_store(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + ODD
    rows = [(3 * k - 40, t, "start") for k, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.store(spark, spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5), WORDS).collect()}
    start = 0
    for doc, text, _ in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert found[doc] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)


def test_store_edge_cases(spark):
    assert token_store.store(spark, spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []
    df = spark.createDataFrame([(None, None), (1, None), (1, "")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["start"], r["n_tokens"]) for r in token_store.store(spark, df, WORDS).collect()) == [(-1, 0, 1), (1, 1, 1), (1, 2, 1)]


def conversations():
    rng = random.Random(8)
    said = ["hi", "", None, "<|im_end|>", "<\\|im_end|> \\<| <|", "line\nline", "🙂 é", "x" * 5000, "<\\\\|"]
    roles = ["user", "assistant", "system", None, "odd\nrole\\", "<|im_start|>"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            # Many conversations begin alike.
            text, role = (said[turn], roles[turn % 2]) if rng.random() < 0.7 else (rng.choice(said), rng.choice(roles))
            rows.append((conv, turn, role, text))
    return [*rows, (None, 1, "user", "lost"), (60, None, "assistant", "no turn"), (60, 1, "assistant", "b"), (60, 1, "assistant", "a")]


def told(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in out.items()}


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, path int")
    out = {r["conv_id"]: r for r in chat.round_trip(spark, df, BYTES, public_tokenizers.PATTERN).collect()}
    expected = told(rows)
    assert out.keys() == expected.keys()
    for conv, turns in expected.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert out[conv]["n_turns"] == len(turns)
        assert out[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (out[conv]["loss_chars"], out[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert out[conv]["formatted_chars"] == sum(len(f"{chat.START}{chat.escape_role(r)}\n{chat.escape(t)}{chat.END}\n") for r, t in turns)


def test_packs_share_turns_and_attend_to_ancestors(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t} {c if t > 1 else ''}") for c in range(30) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.format_conversations(df, BYTES, public_tokenizers.PATTERN).collect()
    words = chat.vocabulary(BYTES, public_tokenizers.PATTERN)
    whole = sum(len(words.turn(r, t)[0]) for _, _, r, t in rows)
    assert sum(len(p["tokens"]) for p in packs) < 0.8 * whole
    for p in packs:
        for start, end, attends in zip(p["turn_start"], p["turn_end"], p["attends"], strict=True):
            seen = [k for x in attends for k in range(x["start"], x["end"])]
            assert [p["position_ids"][k] for k in [*seen, *range(start, end)]] == list(range(len(seen) + end - start))
    assert chat.format_conversations(df.limit(0), BYTES, public_tokenizers.PATTERN).collect() == []


@given(st.text(alphabet="<\\|n\nab", max_size=12))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape_role(chat.escape_role(text)) == text
    assert "<|" not in chat.escape(text) and "\n" not in chat.escape_role(text) and "<|" not in chat.escape_role(text)


def test_chat_query(spark):
    rows = {r["conv_id"]: r for r in queries.QUERIES["op8_chat_formatting"](spark, "/root/testdata/sf0.001").collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert (rows[-1]["n_turns"], rows[-1]["loss_chars"], rows[-1]["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
