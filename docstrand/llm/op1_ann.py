"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrand.llm.common import cut, ship
from docstrand.llm.filtering import BROADCAST
from docstrand.llm.vectors import by_dimension, is_single, matrix, packed, unit

#: Hash tables, and axes that a query looks up in each: found 0.96 of the true 20 nearest among 10,256 unit vectors of
#: 64 dimensions without structure, while reranking 0.35 of them.
TABLES, PROBES = 32, 3
#: Shards of the index, more where one would take over SHARD_BYTES. Each returns its best for every query, so their
#: number doesn't grow with the rows before it must.
SHARDS, SHARD_BYTES = 16, 64 << 20
QUERY_BLOCK = 16384


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray, tables: int, probes: int, seed: int = 11) -> np.ndarray:
    """(rows, tables, probes): the signed axes nearest to each unit vector after each table's pseudo-rotation (three
    times random signs and a Hadamard transform), nearest first. Axis i is 2 i, its negative 2 i + 1."""
    d = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, d - x.shape[1]))).astype(np.float32)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(x), tables, min(probes, d)), np.uint16)
    for t in range(tables):
        y = x
        for signs in rng.choice(np.array([-1, 1], np.float32), (3, d)):
            y = hadamard(y * signs)
        near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
        out[:, t] = 2 * near + (np.take_along_axis(y, near, 1) < 0)
    return out


def padded(dim: int) -> int:
    """The dimension that pseudo-rotations work in."""
    return 1 << max(1, (dim - 1).bit_length())


def hashed(vectors: DataFrame, tables: int) -> DataFrame:
    """vec_id, dim, vec, band (of the length, a factor of about 1.4 each), codes (each table's nearest axis)."""
    ship(vectors.sparkSession)
    single = is_single(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in by_dimension(b.column("embedding")):
                for s in range(0, len(rows), 4096):
                    part, y = rows[s : s + 4096], x[s : s + 4096]
                    codes = axes(unit(y), tables, 1) if len(y) else np.zeros((0, tables), np.uint16)
                    band = np.rint(2 * np.log2(np.sqrt((y * y).sum(axis=1)))) if len(y) else np.zeros(0)
                    band = np.nan_to_num(band, posinf=9999, neginf=-9999)
                    cols = [b.column("vec_id").take(pa.array(part)), pa.array([y.shape[1]] * len(y), pa.int32()), packed(y, single)]
                    cols += [pa.array(band.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["vec_id", "dim", "vec", "band", "codes"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    return rows.mapInArrow(run, "vec_id long, dim int, vec binary, band int, codes binary")


def one_each(rows: DataFrame) -> DataFrame:
    """The checkpointed rows, of several with one vec_id the least by dimension and vector. Only ids are shuffled for that,
    and the rows of the ids that are repeated."""
    ids = cut(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if ids.isEmpty():
        return rows
    ids = F.broadcast(ids) if ids.count() * 16 <= BROADCAST else ids
    kept = rows.join(ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("dim", "vec", "band", "codes")).alias("r"))
    return cut(rows.join(ids, "vec_id", "left_anti").select("vec_id", "dim", "vec", "band", "codes").union(kept.select("vec_id", "r.*")))


class Shard:
    """The tables of one shard's rows of one band: for each table and axis, the set of rows as bits."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        n, self.tables = codes.shape
        self.sets = np.zeros((self.tables, 2 * padded(x.shape[1]), -(-n // 8)), np.uint8)
        row = np.arange(n)
        for t in range(self.tables):
            np.bitwise_or.at(self.sets[t], (codes[:, t], row >> 3), (128 >> (row & 7)).astype(np.uint8))

    def candidates(self, q: np.ndarray, probes: np.ndarray) -> Iterator[np.ndarray]:
        """For each query, the numbers of the rows that share one of its axes. Where these are fewer than four for each of
        the k, further axes are probed, nearest first, until they are enough or all of the rows."""
        least = min(len(self.ids), 4 * self.k)
        for s in range(0, len(probes), 64):
            mask = np.zeros((len(probes[s : s + 64]), self.sets.shape[2]), np.uint8)
            self.probe(mask, probes[s : s + 64])
            poor = np.flatnonzero(np.bitwise_count(mask).sum(axis=1, dtype=np.int64) < least)
            if len(poor):
                further = axes(unit(q[s + poor]), self.tables, self.sets.shape[1] // 2)
                mask[poor] = self.extended(mask[poor], further, probes.shape[2], least)
            for row in np.unpackbits(mask, axis=1, count=len(self.ids)):
                yield np.flatnonzero(row)

    def probe(self, mask: np.ndarray, probes: np.ndarray) -> None:
        for t in range(probes.shape[1]):
            for p in range(probes.shape[2]):
                mask |= self.sets[t, probes[:, t, p]]

    def extended(self, mask: np.ndarray, further: np.ndarray, begin: int, least: int) -> np.ndarray:
        """The masks with further axes: after the nearest side of every axis its far side, the nearest axis last."""
        order = np.concatenate([further, further[:, :, ::-1] ^ 1], axis=2)
        for p in range(begin, order.shape[2]):
            poor = np.flatnonzero(np.bitwise_count(mask).sum(axis=1, dtype=np.int64) < least)
            if not len(poor):
                break
            more = mask[poor]
            self.probe(more, order[poor, :, p : p + 1])
            mask[poor] = more
        return mask

    def nearest(self, own: int, q: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k largest inner products among the rows found, the query's own left out."""
        found = found[self.ids[found] != own]
        x = self.x[found]
        rough = x @ q
        if len(rough) > self.k:
            limit = np.partition(rough, len(rough) - self.k)[len(rough) - self.k]
            near = rough >= limit - 1e-9 * max(1.0, abs(limit))
            found, x = found[near], x[near]
        score = (x * q).sum(axis=1)  # the same sum for equal rows, so that ties are ties
        order = np.lexsort((self.ids[found], -score))[: self.k]
        return self.ids[found][order], score[order]


def search(left: pa.Table, right: pa.Table, k: int, tables: int, probes: int) -> pa.Table:
    """The k nearest of one shard (left) for one block of queries (right)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if left.num_rows and right.num_rows:
        dim = left["dim"][0].as_py()
        ids, x, band = left["vec_id"].to_numpy(), matrix(left["vec"], dim), left["band"].to_numpy()
        codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint16).reshape(len(ids), tables)
        q_ids, q = right["vec_id"].to_numpy(), matrix(right["vec"], dim)
        probe = np.concatenate([axes(unit(q[s : s + 4096]), tables, probes) for s in range(0, len(q), 4096)])
        for v in np.unique(band):
            rows = np.flatnonzero(band == v)
            shard = Shard(ids[rows], x[rows], codes[rows], k)
            for own, vec, found in zip(q_ids, q, shard.candidates(q, probe)):
                near, score = shard.nearest(own, vec, found)
                out.append((np.full(len(near), own), near, score))
    cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
    if out:  # of all bands
        order = np.lexsort((cols[1], -cols[2], cols[0]))
        cols = [c[order] for c in cols]
        begin = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        first = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) < k
        cols = [c[first] for c in cols]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest inner product found for every row that is a query
    (a condition on vec_id).

    Every vector is hashed once. The index is dealt over shards by vec_id; each shard holds the tables of its own rows,
    so a bucket that many equal vectors share is spread over all of them. Queries visit every shard in blocks, take as
    candidates the rows that share one of their `probes` nearest axes in one of the tables, and rerank them by the
    exact inner product; the shards' best are merged by query. As hashing sees directions only, rows are indexed by
    bands of their length; a query that finds too few in a band probes further axes there. Work and partial results are
    queries times shards, so they grow with the square of the rows where the queries are a share of these: with vectors
    that have no structure no bucket spares that at the recall asked for.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null vec_id;
    only vectors of one dimension, 1 or more, are compared. Of rows with one vec_id one counts, the least by dimension and
    vector. An inner product beyond double precision is infinite and ranks as such. A query with fewer than k candidates
    gets all of them; ties go to the smaller vec_id. An empty table gives no rows. Other columns are not read.
    """
    rows = one_each(cut(hashed(vectors, tables))).withColumn("query", is_query)
    sizes = rows.agg(F.sum(F.octet_length("vec") + F.col("dim") * 24).alias("bytes"), F.count_if("query").alias("q")).first()
    shards = max(SHARDS, -(-(sizes["bytes"] or 0) // SHARD_BYTES))
    blocks = max(1, -(-sizes["q"] // QUERY_BLOCK))
    place = F.xxhash64("vec_id")
    to_all = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("dim", "vec_id", "vec", "band", "codes", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), to_all("block", blocks))
    right = rows.where("query").select("dim", "vec_id", "vec", F.pmod(place, F.lit(blocks)).cast("int").alias("block"), to_all("shard", shards))
    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: search(a, b, k, tables, probes), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_cross_polytope(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0)
