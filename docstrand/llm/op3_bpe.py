"""Byte-level BPE, encoding and decoding, by recursive queries of DuckDB inside each task."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrand.llm.common import pieces_of, ship
from docstrand.llm.pieces import REMEMBERED, ByteLevel, memory, vocabulary_path

#: Words of more bytes are contracted by a heap, by the same rule: a query's rounds would each copy the word.
LONG_WORD = 256

#: Each round joins the position rows of every unfinished word to the merge table and contracts each word's leftmost
#: pair of least rank. A word that has no pair left drops out, so its last row holds its ids.
ENCODE = """
with recursive step(w, ts, round) as (
  select w, list(t order by p), 0 from word_bytes group by w
  union all
  select s.w, s.ts[:(b.best % 65536) - 1] || [(b.best // 65536)::int] || s.ts[(b.best % 65536) + 2:], s.round + 1
  from step s join (
    select e.w, min(m.rank::bigint * 65536 + e.p) as best
    from (select w, unnest(ts[:-2]) as l, unnest(ts[2:]) as r, unnest(range(1, len(ts))) as p from step) e
    join merges m on m.l = e.l and m.r = e.r group by e.w) b on b.w = s.w
),
last as (select w, max(round) as round from step group by w),
ids as (select s.w, s.ts from step s join last l on l.w = s.w and l.round = s.round),
positions as (select w, unnest(ts) as t, unnest(range(1, len(ts) + 1)) as p from ids)
select w, string_agg(x.t::varchar, ' ' order by p) as ids, string_agg(v.hex, '' order by p) as bytes
from positions x join vocabulary v on v.t = x.t group by w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def contract_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long word: the leftmost pair of least rank first, by a heap over a linked list."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    n = len(word)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not a or j >= n or parts[j] is not b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for p in parts if p is not None]


def duckdb_words(path: str) -> Callable[[list[bytes]], list[tuple[bytes, bytes]]]:
    """A function of words to (decimal ids joined by spaces, decoded bytes)."""
    import duckdb

    ranks = load_ranks(path)
    names = {r: t for t, r in ranks.items()}
    left, right, rank = [], [], []
    for t, r in ranks.items():
        for k in range(1, len(t)):
            a, b = ranks.get(t[:k]), ranks.get(t[k:])
            if a is not None and b is not None:
                left.append(a), right.append(b), rank.append(r)
    con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
    con.register("m", pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())}))
    con.register("v", pa.table({"t": pa.array(list(names), pa.int32()), "hex": [x.hex() for x in names.values()]}))
    con.execute("create table merges as select * from m")
    con.execute("create table vocabulary as select * from v")
    byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def encode(words: list[bytes]) -> list[tuple[bytes, bytes]]:
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                ids = contract_long(w, ranks)
                out[i] = (b" ".join(b"%d" % x for x in ids), b"".join(names[x] for x in ids))
            else:
                rest.append(i)
        for s in range(0, len(rest), 20_000):
            part = rest[s : s + 20_000]
            flat = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            size = np.array([len(words[i]) for i in part])
            at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            con.register("word_bytes", pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), size), "p": at.astype(np.int32), "t": byte[flat]}))
            got = con.sql(ENCODE).to_arrow_table()
            con.unregister("word_bytes")
            for w, ids, text in zip(got["w"].to_pylist(), got["ids"].to_pylist(), got["bytes"].to_pylist()):
                out[part[w]] = (ids.encode(), bytes.fromhex(text))
        return out

    return encode


def piece_codes(vocabulary: str):
    """Remembered decimal ids of pieces, joined by spaces."""

    def make():
        encode = duckdb_words(vocabulary_path(vocabulary))
        return lambda items: [ids for ids, _ in encode([x.encode() for x in items])]

    return memory(("bpe", vocabulary), make, REMEMBERED)


def token_bytes(vocabulary: str) -> dict[bytes, bytes]:
    """The bytes of each token, by its decimal id."""
    return {b"%d" % r: t for t, r in load_ranks(vocabulary_path(vocabulary)).items()}


def assemble(pieces: list[str], codes: dict[str, bytes], tokens: dict[bytes, bytes]) -> tuple[bytes, bytes]:
    """Decimal ids joined by spaces of a text's pieces, and the bytes that this sequence of ids decodes to."""
    ids = b" ".join([codes[p] for p in pieces])
    return ids, b"".join([tokens[x] for x in ids.split()])


def encode_bpe(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, when `full`, ids (array of int) and decoded (binary).

    A text is split by the vocabulary's pattern, each match encoded separately. The distinct words that a task meets
    are token-position rows of one DuckDB query, which joins the merge table, contracts each word's leftmost pair of
    least rank, and repeats until no pair is left; ordered aggregation gives the ids as text. A document's ids are put
    together from its words', and decoded as one sequence through the vocabulary. Words are remembered up to
    a fixed number of bytes; nothing is shuffled and a lost task is computed again from its rows.

    A very long text is encoded whole, in its batch's memory: some ten times its bytes. A null text counts as empty: 0 tokens and the digests of nothing. Special strings are ordinary text. Repeated rows
    are encoded each. An empty table gives no rows. Other columns of `docs` are not read.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split, tokens = piece_codes(vocabulary), ByteLevel(), token_bytes(vocabulary)
        for b in pieces_of(batches, "text", remember=True):
            texts = [split(x or "") for x in b.column("text").to_pylist()]
            codes = known.learn(texts)
            cols: list[list] = [[] for _ in names[1:]]
            for parts in texts:
                ids, decoded = assemble(parts, codes, tokens)
                row = [ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                if full:
                    row += [np.array(ids.split(), np.int32), decoded]
                for to, v in zip(cols, row):
                    to.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op3_bpe(docs: DataFrame) -> DataFrame:
    return encode_bpe(docs, full=False)
