"""Taking rows out of a table of documents by a decision that was made on narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrand.llm.common import cut

#: Bytes up to which a table of keys may be broadcast.
BROADCAST = 32 << 20


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose (doc_id, hash of text) is not among `dropped` (doc_id, text_hash); nulls compare equal.

    The keys are broadcast if they take BROADCAST bytes at most, else both sides are shuffled by them.
    """
    keys = cut(dropped.select(F.col("doc_id").alias("dropped_id"), F.col("text_hash").alias("dropped_hash")).distinct())
    small = keys.count() * 32 <= BROADCAST
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("dropped_id")) & (F.xxhash64(docs["text"]) == F.col("dropped_hash"))
    return docs.join(F.broadcast(keys) if small else keys, same, "left_anti")


def one_each(docs: DataFrame) -> DataFrame:
    """One row of every doc_id and text that several rows have, and all rows whose doc_id is unique or null."""
    keys = cut(docs.groupBy(F.col("doc_id").alias("repeated_id")).count().where("count > 1 and repeated_id is not null").select("repeated_id"))
    n = keys.count()
    if not n:
        return docs
    keys = F.broadcast(keys) if n * 16 <= BROADCAST else keys
    same = docs["doc_id"] == F.col("repeated_id")
    return docs.join(keys, same, "left_anti").union(docs.join(keys, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))
