"""Connected components of a link table, without collecting a group anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrand.llm.common import cut, ship


def forest(links: DataFrame, most: int = 500_000, roots: bool = False) -> DataFrame:
    """The links (a, b) of each task, reduced to as few with the same reach: (member, smallest member it reaches), at
    most `most` members at a time; those smallest members have a row of their own with `roots`."""
    ship(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parent: dict[int, int]) -> pa.RecordBatch:
            pairs = [(x, root(parent, x)) for x in parent]
            pairs = [p for p in pairs if roots or p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        def root(parent: dict[int, int], x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        parent: dict[int, int] = {}
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(parent, x), root(parent, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > most:
                yield flush(parent)
                parent = {}
        yield flush(parent)

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


#: Links that one task may hold; only what is left of a link table at this size is finished in one.
TASK_LINKS = 500_000


def components(links: DataFrame) -> DataFrame:
    """(id, component): every id of a link (a, b) between two ids, with the smallest id that links reach from it.

    Each task first reduces its links to a forest. While more than TASK_LINKS are left, a round points each id's larger
    neighbours and then its smaller ones at the smallest of them, a grouped minimum and a join each, so a hub's links
    are split over tasks, and reduces again; a round at least halves the trees' depth. What fits one task's memory is
    united there, in one pass. Each round is written to the shared checkpoint folder.

    Links that Python makes must be cut before: a task that makes links and reduces them keeps two Python workers, and an
    executor keeps them all, with what each remembers, for the stages that follow.
    """
    edges, before = reduced(links), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] <= TASK_LINKS:
            edges = forest(edges.coalesce(1), 2 * TASK_LINKS + 2, roots=True)
            break
        if tuple(now) == before:
            edges = edges.union(edges.select("b", "b").distinct())
            break
        before = tuple(now)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = reduced(large.join(least, "a").where("b <> m").select("b", "m").union(least.select("a", "m")).toDF("a", "b"))
    return cut(edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id"))


def reduced(links: DataFrame) -> DataFrame:
    """The distinct links of the tasks' forests, the larger id first."""
    return cut(forest(links).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
