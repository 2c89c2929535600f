"""Token sequences packed by best fit decreasing, with their binary outputs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrand.llm.common import pieces_of, ship
from docstrand.llm.op9_packing import word_bytes
from docstrand.llm.pieces import REMEMBERED, words

SCHEMA = (
    "block long, row int, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, starts array<long>, doc_tokens array<long>"
)


class CapacityTree:
    """Open sequences by the room they have left; finds the least room that still fits, in log2(most) steps."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.bins[room].append(sequence)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) of a sequence with the least room of `least` or more, taken out; None if there is none."""
        i, count = least + self.size, self.count
        while not count[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        sequence = self.bins[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, sequence


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Indices of the pieces in each sequence: longest piece first, each into the fullest sequence that it fits."""
    tree, out = CapacityTree(most), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        room, k = found if found else (most, len(out))
        if not found:
            out.append([])
        out[k].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], k)
    return out


def pack_best_fit(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, pad_id: int = 0, most: int = 2048, block_tokens: int = 8 << 20) -> DataFrame:
    """One row per packed sequence: (block, row) names it; ids is its row of the id matrix (`most` little-endian unsigned
    32-bit ids, padded with pad_id), n_tokens those without padding, cu_seqlens the cumulative segment lengths from 0,
    position_resets the offsets at which positions start at 0 again, and doc_ids, starts, doc_tokens tell for each
    segment its document, the document's ids before it, and the document's ids in all.

    A document's ids end with end_id. A document of more than `most` ids is cut losslessly into full rows and a rest.
    Each task packs its own documents, a block of about `block_tokens` ids at a time, so memory is bounded, no row is
    shuffled, and a hot source is no different from any other; at most one sequence a block has more room than half.

    A very long text is encoded whole, in its batch's memory, and its rows are in its task's block. A null text counts as
    empty: the end id alone. Repeated rows are packed each. A null doc_id stays null. An empty
    table gives no rows. Other columns of `docs` are not read.
    """
    ship(docs.sparkSession)

    def rows(block: int, pieces: list[tuple], ids: list[bytes]) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9)]
        pad = np.array([pad_id], "<u4").tobytes()
        for k, members in enumerate(best_fit([p[2] for p in pieces], most)):
            ends = list(accumulate((pieces[i][2] for i in members), initial=0))
            n = ends[-1]
            row = (
                block, k, b"".join([*(ids[i] for i in members), pad * (most - n)]), n, ends, ends[:-1],
                [pieces[i][0] for i in members], [pieces[i][1] for i in members], [pieces[i][3] for i in members],
            )
            for to, v in zip(cols, row):
                to.append(v)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), ints, ints, longs, longs, longs)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = word_bytes(vocabulary, REMEMBERED)
        end = np.array([end_id], "<u4").tobytes()
        block, total = TaskContext.get().partitionId() << 33, 0
        pieces: list[tuple] = []
        ids: list[bytes] = []
        for b in pieces_of(batches, "text", 1 << 20, remember=True):
            split = [words(x or "") for x in b.column("text").to_pylist()]
            of = known.learn(split).__getitem__
            for doc, parts in zip(b.column("doc_id").to_pylist(), split):
                whole = b"".join(map(of, parts)) + end
                n = len(whole) // 4
                for at in range(0, n, most):
                    k = min(most, n - at)
                    pieces.append((doc, at, k, n))
                    ids.append(whole[4 * at : 4 * (at + k)])
                total += n
                if total >= block_tokens:
                    yield rows(block, pieces, ids)
                    block, total, pieces, ids = block + 1, 0, [], []
        if pieces:
            yield rows(block, pieces, ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, the id matrix a binary column in row order within each block."""
    packed.write.parquet(path)


def op7_best_fit(docs: DataFrame) -> DataFrame:
    """The packed rows, the id matrix among them, and a digest of each row of it."""
    return pack_best_fit(docs).select(
        "block", "row", "n_tokens", "ids", F.crc32("ids").alias("ids_crc32"), "cu_seqlens", "position_resets", "doc_ids", "starts", "doc_tokens"
    )
