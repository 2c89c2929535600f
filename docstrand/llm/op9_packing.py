"""Packing by power-of-two decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrand.llm.common import pieces_of, ship
from docstrand.llm.pieces import REMEMBERED, WORD_LEVEL, library_ids, memory, vocabulary_path, words

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: Bytes of text that a worker packs at once.
BATCH = 1 << 20


def word_bytes(vocabulary: str, remembered: int):
    """Remembered ids of words as little-endian 32-bit bytes, by the lower-casing word vocabulary."""

    def make():
        ids = library_ids(vocabulary_path(vocabulary), WORD_LEVEL, True)
        return lambda items: [np.array(x, "<u4").tobytes() for x in ids(items)]

    return memory(("word", vocabulary), make, remembered)


def binary_lengths(n: int, most: int) -> list[int]:
    """n as a sum of powers of two, largest first, none above `most`."""
    out = [most] * (n // most)
    rest, bit = n % most, most
    while rest:
        bit >>= 1
        if rest >= bit:
            out.append(bit)
            rest -= bit
    return out


def pack_binary(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, most: int = 4096, remembered: int = REMEMBERED, batch: int = BATCH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id,
    offset.

    Each document's ids and its end id are cut into pieces of `most` (a power of two) and then of the powers of two
    that sum to the rest, largest first. A piece is a sequence by itself at offset 0, so no sequence crosses documents
    and none needs padding; `bucket` is log2 of its length. Each batch of documents (about `batch` bytes of text) returns its pieces
    by bucket, the longest first, and write_buckets gives each bucket a folder of its own. It is one narrow pass
    without a shuffle; a lost task is computed again from its input rows. sequence_id is unique, not consecutive. A very
    long text is encoded whole, in its batch's memory. A worker remembers what words encode to, `remembered` bytes of it.

    A null text counts as empty: its document is the end id alone. A repeated row or doc_id gives pieces of its own. A
    null doc_id stays null. An empty table gives no rows. Other columns of `docs` are not read.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_bytes(vocabulary, remembered)
        end = np.array([end_id], "<u4").tobytes()
        for b in pieces_of(batches, "text", batch, remember=True):
            split = [words(x or "") for x in b.column("text").to_pylist()]
            of = known.learn(split).__getitem__
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, parts in zip(b.column("doc_id").to_pylist(), split):
                ids = b"".join(map(of, parts)) + end
                n, at = len(ids) // 4, 0
                for k in binary_lengths(n, most):
                    for to, v in zip(rows, (doc, at, k, ids[4 * at : 4 * (at + k)], n)):
                        to.append(v)
                    at += k
            # equal lengths together
            order = sorted(range(len(rows[2])), key=rows[2].__getitem__, reverse=True)
            rows = tuple([v[i] for i in order] for v in rows)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA)
    return out.withColumns(
        {
            "bucket": F.log2("length").cast("int"),
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """The packed pieces as Parquet, a folder for each bucket, so that a reader batches rows of one length without padding."""
    packed.write.partitionBy("bucket").parquet(path)


def op9_power_of_two(docs: DataFrame) -> DataFrame:
    return pack_binary(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
