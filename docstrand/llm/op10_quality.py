"""Document quality: a classifier's evidence combined with empirical-Bayes posteriors of hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrand.llm import hashing
from docstrand.llm.common import cut, pieces_of, ship
from docstrand.llm.op4_urls import SALTS, prior_weight

#: Labelled documents that the classifier is fitted on, at most, chosen by a hash of doc_id.
SAMPLE = 20_000
MILLION = 1_000_000
FEATURES = ("words", "upper", "symbols", "bars", "repeats", "distinct", "word_length", "digits", "stops")
_CLASS = np.zeros((6, 256), bool)
_CLASS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True  # letters
_CLASS[1, 65:91] = True  # capitals
_CLASS[2, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?()|"]] = True  # symbols
_CLASS[3, ord("|")] = True
_CLASS[4, 48:58] = True
_CLASS[5, [ord("."), ord("?"), ord("!")]] = True


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text; a null counts as empty."""
    raw = [(x or "").encode() for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(x) for x in raw])
    at = np.concatenate([[0], np.cumsum(size)])
    n = len(raw)
    full = np.flatnonzero(size)
    sums = np.zeros((len(_CLASS), n))
    for i, c in enumerate(_CLASS):
        if len(full):
            sums[i, full] = np.add.reduceat(c[data], at[full], dtype=np.int64)
    letters, upper, symbols, bars, digits, stops = sums
    doc, h = hashing.words(texts)
    words = np.bincount(doc, minlength=n)
    same = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    begin = np.concatenate([[0], np.cumsum(words)])
    distinct = np.array([len(np.unique(h[s:e])) for s, e in zip(begin[:-1], begin[1:])])
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    return np.column_stack(
        [
            np.log1p(words), np.sqrt(upper / np.maximum(letters, 1)), np.sqrt(symbols / b), np.sqrt(bars / b), np.sqrt(same / w),
            np.log(np.maximum(distinct, 1)) / np.log(w + 1), np.log1p(letters / w), np.sqrt(digits / b), np.sqrt(stops / w),
        ]
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source and the features of every row; text_hash tells rows with one doc_id apart."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "text", 1 << 20):
            x = features(b.column("text").to_pylist())
            cols = [b.column(c) for c in ("doc_id", "text_hash", "source")]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, pa.float64()) for c in x.T)], ["doc_id", "text_hash", "source", *FEATURES])

    schema = "doc_id long, text_hash long, source string, " + ", ".join(f"{c} double" for c in FEATURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, schema)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on the raw features and their squares, by Newton's method."""
    if not len(y) or y.min() == y.max():
        return np.zeros(2 * x.shape[1]), 0.0
    z = np.column_stack([x, x * x])
    mean, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 1e-6)
    a = np.column_stack([np.ones(len(y)), (z - mean) / scale])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return weights, float(w[0] - weights @ mean)


def train(rows: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The classifier, from labelled rows of measured documents (a column good, 0 or 1, or null), each text of a doc_id
    once: those whose hash is below the share that leaves `sample` less five times its root, so that more than `sample`
    come with a chance below one in a million. The executors return no others; their order doesn't matter."""
    known = rows.where("good is not null").select("doc_id", "text_hash", "good", *FEATURES)
    share = min(1.0, max(1.0, sample - 5 * sample**0.5) / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = some.dropDuplicates(["doc_id", "text_hash"]).select("good", *FEATURES).collect()
    data = np.array(sorted(tuple(r) for r in some), float).reshape(-1, 1 + len(FEATURES))
    return fit(data[:, 1:], data[:, 0])


def site_quality(rows: DataFrame, threshold: float) -> DataFrame:
    """Adds host, path and the combined columns to measured rows with p_doc and good.

    A document's evidence is its label where it has one, else p_doc. Evidence is summed by (host, path), then by host.
    A host's mean is shrunk toward that of all, a path's toward its host's, with the weights that the spread between
    hosts and between paths supports; a document's own evidence is left out of its path's posterior.
    """
    # sums of whole millionths don't hang on their order
    evidence = F.round(F.coalesce(F.col("good").cast("double"), F.col("p_doc")) * MILLION).cast("long")
    rows = rows.withColumns({"host": F.coalesce(F.split_part("source", F.lit("/"), F.lit(1)), F.lit("")), "path": F.coalesce(F.split_part("source", F.lit("/"), F.lit(2)), F.lit(""))})
    # "bad" is what prior_weight calls the outcome it counts
    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), (F.sum(evidence) / MILLION).alias("bad"), F.sum(evidence).alias("units")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), (F.sum("units") / MILLION).alias("bad"))
    (m_host, mean), (m_path, _) = prior_weight(hosts), prior_weight(paths)
    shrunk = hosts.select("host", F.round((F.col("bad") + m_host * mean) / (F.col("n") + m_host), 9).alias("host_mean"))
    sites = paths.join(shrunk, "host").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumns({"salt": F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")}).join(sites, ["host", "path", "salt"])
    site = F.round(((F.col("units") - evidence) / MILLION + m_path * F.col("host_mean")) / (F.col("n") - 1 + m_path), 9)
    bounded = F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6))
    mean = min(max(round(mean, 9), 1e-6), 1 - 1e-6)
    logit = F.log(F.col("p_doc") / (1 - F.col("p_doc"))) + F.log(bounded / (1 - bounded)) - float(np.log(mean / (1 - mean)))
    quality = F.round(1 / (1 + F.exp(-logit)), 6)
    return rows.select("doc_id", "text_hash", "host", "path", "p_doc", "host_mean", site.alias("path_mean"), quality.alias("quality"), (quality >= threshold).alias("kept"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text_hash, host, path, p_doc, host_mean, path_mean, quality and kept (quality >= threshold) of every row.

    p_doc comes from a logistic regression on surface features of the whole text, fitted on at most `sample` labelled
    documents (doc_id, quality 0 or 1; a document with several labels has the least). Host and path are the first two
    parts of `source` at "/"; a source without "/" has the empty path. The classifier's log odds and those of the
    path's posterior against all documents' are added.

    p_doc, the site means and quality are rounded, and sums taken in whole millionths, so that no order of rows tells.
    A null text counts as empty; a very long one is measured whole, in its batch's memory. A null source is the host "".
    A null doc_id has no label. Repeated rows are scored each, alike. Without labels, or with labels of one kind, p_doc is
    0.5. An empty table gives no rows. Other columns are not read.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("good"))
    rows = cut(measured(docs).join(known, "doc_id", "left"))
    weights, intercept = train(rows, sample)
    z = F.lit(intercept)
    for i, c in enumerate(FEATURES):
        z = z + float(weights[i]) * F.col(c) + float(weights[i + len(FEATURES)]) * F.col(c) * F.col(c)
    p = F.round(1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0)))), 6)
    return site_quality(rows.withColumn("p_doc", p), threshold)


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, labels).drop("text_hash")
