"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrand.llm.common import cut, parallelism, ship
from docstrand.llm.components import components
from docstrand.llm.vectors import by_dimension, is_single, matrix, packed, unit

#: Least passes, and passes in one round; hash bits that each orders by; how many rows before it a row is compared with.
PASSES, BITS, WINDOW = 12, 64, 24
#: The greatest chance that no pass compares an isolated pair at the threshold, by which the number of passes is set.
MISS = 1e-3
#: Rows of a component that are compared with each other in one task.
BLOCK = 1024
_ROW = "pass int, label long, dim int, node long, vec binary"


def pass_chance(rows: int, window: int, least: float) -> float:
    """How likely one pass at least compares an isolated pair of cosine `least` among `rows` vectors without structure.

    A projection parts the pair with probability angle / pi. If that first happens after k bits, all rows between the
    two share those k bits, which about rows / 2^k others do (Poisson).
    """
    if rows <= window + 1:
        return 1.0
    apart = math.acos(max(-1.0, min(1.0, least))) / math.pi

    def fit(mean: float) -> float:
        term, total = math.exp(-mean), 0.0
        for k in range(window):
            total += term
            term *= mean / (k + 1)
        return min(1.0, total)

    return sum(apart * (1 - apart) ** k * fit(rows / 2**k) for k in range(BITS)) + (1 - apart) ** BITS * fit(rows / 2**BITS)


def passes_for(rows: int, window: int = WINDOW, least: float = 0.93) -> int:
    """Passes, PASSES or more, after which such a pair is missed with probability MISS at most."""
    chance = pass_chance(rows, window, least)
    return PASSES if chance >= 1 - MISS else max(PASSES, math.ceil(math.log(MISS) / math.log1p(-chance)))


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, print (16 bytes, equal for equal vectors), vec, for those that take part."""
    ship(vectors.sparkSession)
    single = is_single(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in by_dimension(b.column("embedding")):
                at = pa.array(rows)
                prints = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x + 0.0]
                cols = [b.column("vec_id").take(at), b.column("label").take(at), pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, packed(x, single)], ["vec_id", "label", "dim", "print", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and label is not null")
    return rows.mapInArrow(run, "vec_id long, label long, dim int, print binary, vec binary")


def keyed(reps: DataFrame, passes: range) -> DataFrame:
    """Each row once a pass, with that pass's concatenated sign bits of random projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                rows = b.filter(pa.array(dims == d))
                x = unit(matrix(rows.column("vec"), int(d)))
                for p in passes:
                    planes = np.random.default_rng([p, int(d)]).standard_normal((int(d), BITS))
                    keys = np.packbits(x @ planes > 0, axis=1)
                    cols = [pa.array([p] * len(x), pa.int32()), rows.column("label"), rows.column("dim"), pa.array([k.tobytes() for k in keys], pa.binary()), rows.column("node"), rows.column("vec")]
                    yield pa.RecordBatch.from_arrays(cols, ["pass", "label", "dim", "key", "node", "vec"])

    return reps.select("label", "dim", "node", "vec").mapInArrow(run, "pass int, label long, dim int, key binary, node long, vec binary")


def neighbours(rows: pa.Table, carried: int, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of sorted rows up to `window` apart, the later one beyond the first `carried`."""
    group = np.column_stack([rows["pass"].to_numpy(), rows["label"].to_numpy(), rows["dim"].to_numpy()])
    ids, a, b = rows["node"].to_numpy(), [], []
    cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
    for s, e in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ids)]])):
        if e - s < 2:
            continue
        x = unit(matrix(rows["vec"].slice(s, e - s), int(group[s, 2])))
        for gap in range(1, min(window, e - s - 1) + 1):
            hit = np.flatnonzero(np.einsum("ij,ij->i", x[gap:], x[:-gap]) >= least)
            hit = hit[hit + gap + s >= carried]
            a.append(ids[s + hit + gap])
            b.append(ids[s + hit])
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def sorted_links(reps: DataFrame, passes: range, window: int, least: float) -> DataFrame:
    """Links (a, b) between rows that stand close together in one of the passes' orders.

    A pass's order runs over range partitions; the first and last rows of each are returned beside the links, and
    compared across the border in a second, small step.
    """
    names = ["a", "b", "border", "late", "pass", "label", "dim", "node", "vec"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), k) for k in kinds[2:])], names)

    def edge(rows: pa.Table, border: int, late: int) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        rows = rows.combine_chunks()
        own = [rows[c].chunk(0) if n else pa.nulls(0, k) for c, k in zip(names[4:], kinds[4:])]
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([border] * n, pa.int32()), pa.array([late] * n, pa.int32()), *own], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        head = tail = None
        for b in batches:
            for s in range(0, b.num_rows, 8192):
                new = pa.Table.from_batches([b.slice(s, 8192)]).select(names[4:])
                head = new.slice(0, window) if head is None else head if head.num_rows >= window else pa.concat_tables([head, new.slice(0, window - head.num_rows)])
                carried = 0 if tail is None else tail.num_rows
                both = new if tail is None else pa.concat_tables([tail, new])
                yield links(*neighbours(both, carried, window, least))
                tail = both.slice(max(0, both.num_rows - window))
        if head is not None:
            yield from edge(head, part - 1, 1)
            yield from edge(tail, part, 0)

    def across(t: pa.Table) -> pa.Table:
        early, late = (t.filter(pc.equal(t["late"], x)) for x in (0, 1))
        both = pa.concat_tables([early, late])
        a, b = neighbours(both, early.num_rows, window, least)
        # rows of a border are few, but only pairs that cross it are new
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    order = ["pass", "label", "dim", "key", "node"]
    schema = "a long, b long, border int, late int, " + _ROW
    ranged = keyed(reps, passes).repartitionByRange(parallelism(reps.sparkSession), *order).sortWithinPartitions(*order)
    # the order within a border's side is that of its partition
    found = cut(ranged.select("pass", "label", "dim", "node", "vec").mapInArrow(run, schema))
    edges = found.where("border is not null").select("border", "late", "pass", "label", "dim", "node", "vec")
    return found.where("border is null").select("a", "b").union(cut(edges.groupBy("border").applyInArrow(across, "a long, b long")))


def link_counts(members: DataFrame, least: float) -> DataFrame:
    """(node, n): how many vectors link with each member of a component, copies counted each, itself left out.

    members: node, component, vec, copies, and lead, the vector of the component's first member. Members within half
    the threshold's angle of the lead all link with each other, so they are counted without being compared. The rest
    are compared with all members of their component, in blocks.
    """
    half = float(np.cos(np.arccos(least) / 2)) + 1e-9

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, core = b.column("dim").to_numpy(), np.zeros(b.num_rows, bool)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                one, two = (unit(matrix(b.column(c).take(pa.array(at)), int(d))) for c in ("vec", "lead"))
                core[at] = (one * two).sum(axis=1) >= half
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "component", "dim", "vec", "copies")), pa.array(core, pa.bool_())], ["node", "component", "dim", "vec", "copies", "core"])

    rows = cut(members.select("node", "component", "dim", "vec", "copies", "lead").mapInArrow(near, "node long, component long, dim int, vec binary, copies long, core boolean"))
    sums = rows.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("in_core"), F.count("*").alias("size"), F.count_if(~F.col("core")).alias("rest")
    )
    rows = rows.join(sums, "component")
    own = rows.select("node", F.when(F.col("core"), F.col("in_core") - 1).otherwise(F.col("copies") - 1).alias("n"))

    blocks, rests = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil(F.col("rest") / BLOCK).cast("int")
    place = F.xxhash64("node")
    apart = rows.where("rest > 0")
    left = apart.select("component", "node", "dim", "vec", "copies", "core", F.pmod(place, blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), rests - 1)).alias("other"))
    fresh = [F.col(c).alias(c) for c in ("component", "node", "dim", "vec", "copies")]  # else Spark takes both sides' columns for the same
    right = apart.where("not core").select(*fresh, F.pmod(place, rests).cast("int").alias("other"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if a.num_rows and b.num_rows:
            one, two = a["node"].to_numpy(), b["node"].to_numpy()
            hit = unit(matrix(b["vec"], b["dim"][0].as_py())) @ unit(matrix(a["vec"], a["dim"][0].as_py())).T >= least
            hit &= two[:, None] != one[None, :]
            core = a["core"].to_numpy(zero_copy_only=False)
            ids = np.concatenate([two, one[core]])
            n = np.concatenate([hit @ a["copies"].to_numpy(), b["copies"].to_numpy() @ hit[:, core]])
        return pa.table({"node": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())})

    keys = ("component", "block", "other")
    more = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "node long, n long")
    return own.union(more).groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, least: float = 0.93, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; only rows of one label (and dimension) are compared.

    Equal vectors of one label are one from the start, counted with their copies. In each of `passes` orders, by label and
    then by the concatenated sign bits of random projections, a row is compared with the `window` rows before it; verified
    pairs of all passes are united into components. The orders are range-partitioned, and rows with equal hashes are
    told apart by a number, so no group, however large, is one task's. Within a component all links are then counted
    exactly, but a link that no pass compares, and that no others stand for, is lost with what it would join. Unless
    `passes` is given, it grows with the distinct vectors of the largest label (and dimension), so that an isolated pair
    of cosine `least` among vectors without other structure is missed with probability MISS at most. PASSES at a time
    are made and united, so that what is shuffled at once doesn't grow with their number.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null label or vec_id, link with
    nothing: n_links 0, component_id their own vec_id, kept. Repeated rows count as copies of each other. Rows of one
    vec_id with different labels or vectors are vectors of their own, each with its own links and component. An empty
    table gives no rows. Other columns are not read.
    """
    rows = cut(prepared(vectors))
    same = rows.groupBy("label", "dim", "print").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.min("vec").alias("vec"))
    # the checkpoint settles which of them has which number
    reps = cut(same.withColumn("node", F.monotonically_increasing_id()))
    if passes is None:
        passes = passes_for(reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0, window, least)
    found = None
    for p in range(0, passes, PASSES):
        links = sorted_links(reps, range(p, min(p + PASSES, passes)), window, least)
        found = cut(components(links if found is None else links.union(found.select("id", "component"))))
    placed = reps.join(found.withColumnRenamed("id", "node"), "node")
    lead = reps.select(F.col("node").alias("component"), F.col("vec").alias("lead"))
    counts = link_counts(placed.join(lead, "component"), least)
    first = cut(placed.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    placed = placed.select("node", "component").join(first, "component")
    known = reps.select("node", "label", "dim", "print", "copies", "vec_id").join(placed, "node", "left").join(counts, "node", "left")
    known = known.select("label", "dim", "print", F.coalesce("n", F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    part = rows.select("vec_id", "label", "dim", "print").join(known, ["label", "dim", "print"]).select("vec_id", "n_links", "component_id")
    rest = absent(vectors)
    out = part.union(rest.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def absent(vectors: DataFrame) -> DataFrame:
    """Rows that take no part, by the same conditions as those that do, in built-in functions."""
    x = F.col("embedding").cast("array<double>")
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    )
    return vectors.where(~F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"))


def op2_sorted_passes(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)
