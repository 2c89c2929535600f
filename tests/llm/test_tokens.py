"""Byte-level BPE, counts and packing against the libraries, on awkward texts."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from docstrand.llm.op3_bpe import assemble, contract_long, encode_bpe, load_ranks, op3_bpe, token_bytes
from docstrand.llm import hashing
from docstrand.llm.op6_token_counts import op6_token_counts
from docstrand.llm.op7_bestfit import best_fit, op7_best_fit, pack_best_fit, write_packed
from docstrand.llm.op9_packing import binary_lengths, op9_power_of_two, pack_binary, write_buckets
from docstrand.llm.pieces import Memory
from pyspark.sql import functions as F

TEXTS = [
    None, "", " ", "\n\n  \t", "Hello, world's  best!", "it's we'll I'M 'S don't", "naïve Éclair ß Straße 12345 ½ ²", "日本語のテキスト 数字１２３", "emoji 🙂🙃 é ñ",
    " \n\n x   y　z ", "a<|endoftext|>b <|endoftext|> c<|startoftext|>", "aaaa" * 300, "ab" * 700 + "!" * 300, "x" * 70_000, "tab\tsep\x0bvt\x0cff\r\nend  ",
    "\x1c\x1d control \x85 next line", "Ünï ΑΣ Σ ΟΔΟΣ İstanbul ǅ", "mixed12ab 3.14 -- ***", "ↅ Ⅷ ⑨ 𝟘 ", "꟎ new letter \U0001df90",
]
SCHEMA = "text string, doc_id long, start string, ids int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(t, i, "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[4], ("null id", None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tiktoken_encoding():
    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktokens(docs, empty):
    enc, rows = tiktoken_encoding(), encode_bpe(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids), text[:30]
        assert bytes(r.decoded) == text.encode() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert op3_bpe(empty).count() == 0


def test_documents_are_decoded_from_their_ids():
    tokens = token_bytes("byte_bpe_50k.tiktoken")
    one, two = (next(i for i, x in tokens.items() if x == w) for w in (b"a", b"b"))
    assert assemble(["a", "b"], {"a": one, "b": two}, tokens) == (one + b" " + two, b"ab")
    assert assemble(["a", "b"], {"a": two, "b": one}, tokens) == (two + b" " + one, b"ba")  # wrong ids show
    assert assemble([], {}, tokens) == (b"", b"")


def test_long_words_by_heap():
    ranks, enc = load_ranks(P.path("byte_bpe_50k.tiktoken")), tiktoken_encoding()
    rng = np.random.default_rng(1)
    for n in (1, 2, 300, 2000):
        word = "".join(rng.choice(list("abcéh t"), n)).replace(" ", "")
        assert contract_long(word.encode(), ranks) == enc._encode_single_piece(word.encode())


def test_counts_are_the_librarys(docs, empty):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in op6_token_counts(docs).collect():
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 1024), text[:30]
    assert op6_token_counts(empty).count() == 0


def word_ids(text):
    return Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids + [2]


def test_binary_packing_round_trip(docs, empty):
    rows = pack_binary(docs, most=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by_doc = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 == 2**r.bucket <= 64 and r.offset == 0
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS):
        want = word_ids(text)
        parts = sorted(by_doc[i], key=lambda r: (r.sequence_id, r.start))
        got = np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist()
        assert got == want * (2 if i == 4 else 1), str(text)[:30]
        assert {p.doc_tokens for p in parts} == {len(want)}
    one = {(r.doc_id, r.start): r.ids_crc32 for r in op9_power_of_two(docs).collect()}
    first = np.array(word_ids(TEXTS[4]), "<u4")
    n = binary_lengths(len(first), 4096)[0]
    assert one[4, 0] == zlib.crc32(first[:n].tobytes())
    assert op9_power_of_two(empty).count() == 0
    assert binary_lengths(13, 4) == [4, 4, 4, 1] and binary_lengths(0, 4) == [] and binary_lengths(4096, 4096) == [4096]


def test_small_batches_are_packed_alike(docs):
    few, many = (sorted((r.doc_id is None, r.doc_id or 0, r.start, bytes(r.ids), r.doc_tokens) for r in pack_binary(docs, batch=b).collect()) for b in (1, 1 << 20))
    assert few == many and len({r.sequence_id for r in pack_binary(docs, batch=1).collect()}) == len(many)


def test_best_fit_packing_round_trip(docs, empty):
    rows, found = pack_best_fit(docs, most=128, block_tokens=500).collect(), {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == 128 and (ids[r.n_tokens :] == 0).all() and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts)):
            found.setdefault(doc, []).append((start, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist(), r.doc_tokens[k]))
    for i, text in enumerate(TEXTS):
        want = word_ids(text)
        if i != 4:
            assert sum((p for _, p, _ in sorted(found[i])), []) == want
        assert {n for _, _, n in found[i]} == {len(want)}
    assert pack_best_fit(empty).count() == 0


def test_packed_matrix_is_written_and_read_back(spark, docs, tmp_path):
    write_packed(op7_best_fit(docs), str(tmp_path / "packed"))
    found = {}
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == 2048 and (ids[r.n_tokens :] == 0).all() and zlib.crc32(ids.tobytes()) == r.ids_crc32
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert len(r.doc_ids) == len(r.starts) == len(r.doc_tokens) == len(r.position_resets)
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts)):
            found.setdefault(doc, []).append((start, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    for i, text in enumerate(TEXTS):
        assert sum((p for _, p in sorted(found[i])), []) == word_ids(text) * (2 if i == 4 else 1)


def test_best_fit_is_best_fit_decreasing():
    for seed in range(10):
        lengths = np.random.default_rng(seed).integers(1, 65, 150).tolist()
        rooms = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = [k for k, r in enumerate(rooms) if r >= lengths[i]]
            if fit:
                rooms[min(fit, key=lambda k: rooms[k])] -= lengths[i]
            else:
                rooms.append(64 - lengths[i])
        packed = best_fit(lengths, 64)
        assert sorted(64 - sum(lengths[i] for i in m) for m in packed) == sorted(rooms)
        assert sorted(i for m in packed for i in m) == list(range(len(lengths)))


def test_ranks_file():
    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"))
    assert len(ranks) == 50256 and base64.b64encode(b"the") and ranks[b"the"]


def test_buckets_are_folders_of_one_length(spark, docs, tmp_path):
    write_buckets(pack_binary(docs), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == pack_binary(docs).count()
    for r in back.groupBy("bucket").agg(F.min("length").alias("low"), F.max("length").alias("high")).collect():
        assert r.low == r.high == 2**r.bucket
    lengths = [r.length for r in pack_binary(docs.coalesce(1)).collect()]
    assert lengths[:50] == sorted(lengths[:50], reverse=True)


def test_memory_is_bounded_by_bytes():
    m = Memory(lambda items: [x.encode() for x in items], most=10_000)
    for i in range(50):
        got = m.learn([[f"w{i}-{k}" for k in range(20)], ["long " * 100 + str(i)]])
        assert got[f"w{i}-3"] == f"w{i}-3".encode() and got["long " * 100 + str(i)]
        assert m.size < 15_000 and sum(len(x) > 64 for x in m.known) == 1


def test_words_are_hashed_alike_in_any_window(monkeypatch):
    texts = [None, "", "a", "A b\tc", "é" * 10, " ".join("w" * (i % 40 + 1) + str(i) for i in range(300)), "x" * 5000 + " y " + "z" * 70]
    want = hashing.words(texts)
    for size in (64, 1000):
        monkeypatch.setattr(hashing, "WINDOW", size)
        monkeypatch.setattr(hashing, "_POWERS", [])
        assert all((a == b).all() for a, b in zip(hashing.words(texts), want))
