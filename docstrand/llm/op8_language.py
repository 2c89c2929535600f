"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrand.llm.common import pieces_of, ship
from docstrand.llm.hashing import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)

#: The n-grams' lengths, in letters, and how many a profile has.
LENGTHS, MOST = (1, 2, 3), 400
#: Bits of an n-gram's hash; the others of a 64-bit key tell the texts of a batch apart.
BITS = 48
#: Bytes of text that are counted at once; counts that a task holds before it hands them on.
PART, HELD = 1 << 18, 1 << 19
_KINDS: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0) & doc_id.isNotNull()


def kinds() -> np.ndarray:
    """For every code point: 2 for a letter, 1 for a mark, which is part of a word too, 0 for any other."""
    if not _KINDS:
        of = {"L": 2, "M": 1}
        _KINDS.append(np.fromiter((of.get(unicodedata.category(chr(x))[0], 0) for x in range(0x110000)), np.uint8, 0x110000))
    return _KINDS[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of every n-gram of the lengths in LENGTHS, and how many letters each text has.

    Texts are lower-cased code points; all that stands between two words is one gap, and a gap is only ever the first or the
    last of an n-gram, and never all of it.
    """
    low = ["\0" + (x or "").lower() + "\0" for x in texts]
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[c]
    doc = np.repeat(np.arange(len(low), dtype=np.int64), [len(x) for x in low])
    letters = np.bincount(doc[kind == 2], minlength=len(low))
    inside = kind > 0
    keep = np.ones(len(c), bool)
    keep[1:] = inside[1:] | inside[:-1]
    c, doc, inside = np.where(inside, c, 0)[keep].astype(np.uint64), doc[keep], inside[keep]
    docs, codes = [], []
    h = np.zeros(len(c), np.uint64)
    whole = np.ones(len(c), bool)  # no gap between the first and the last
    for n in range(1, min(max(LENGTHS), len(c)) + 1):
        h = h[: len(c) - n + 1] * _BASE + c[n - 1 :] + np.uint64(n)
        if n > 2:
            whole = whole[: len(h)] & inside[n - 2 : n - 2 + len(h)]
        if n in LENGTHS:
            first = inside[: len(h)]
            some = whole if n > 2 else first | inside[n - 1 :]
            # a gap before a text may be that after the text before it
            docs.append(np.where(first, doc[: len(h)], doc[min(1, n - 1) :][: len(h)])[some])
            codes.append(mix(h[some]) >> np.uint64(64 - BITS))
    return np.concatenate(docs), np.concatenate(codes), letters


def counted(number: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, code, how often) of each distinct pair, in order."""
    key = np.sort((number.astype(np.uint64) << np.uint64(BITS)) | code)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), n


def top_grams(doc: np.ndarray, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, code, rank from 0) of each text's most frequent n-grams; ties by code."""
    d, code, n = counted(doc, code)
    order = np.lexsort((-n, d))
    d, code = d[order], code[order]
    begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    rank = np.arange(len(d)) - np.repeat(begin, np.diff(np.append(begin, len(d))))
    keep = rank < most
    return d[keep], code[keep], rank[keep]


def train_profiles(labelled: DataFrame, most: int = MOST) -> dict[str, list[int]]:
    """The most frequent n-grams of each language, most frequent first, from all rows of (text, lang).

    Counts are summed inside each task before they are shuffled, and ranked by language in two steps, so that no task meets all
    n-grams of a language. The result is `most` numbers a language: as the number of languages is the labels', it is the one
    thing here that the labels, not the texts, can make grow.
    """
    ship(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            for x in sorted({h[0] for h in held}):
                code, n = (np.concatenate([h[i] for h in held if h[0] == x]) for i in (1, 2))
                order = np.argsort(code, kind="stable")
                code, n = code[order], n[order]
                at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                n = np.add.reduceat(n, at)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(code[at]), pa.array(n)], ["lang", "code", "n"])
            held.clear()

        for b in pieces_of(batches, "text", PART):
            langs = b.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            doc, code, _ = grams(b.column("text").to_pylist())
            which, code, n = counted(np.array([number[x] for x in langs])[doc], code)
            for i, x in enumerate(names):
                s, e = np.searchsorted(which, [i, i + 1])
                if e > s:
                    held.append((x, code[s:e], n[s:e]))
            if sum(len(h[1]) for h in held) > HELD:
                yield from out()
        yield from out()

    counts = labelled.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = (F.desc("n"), "code")
    share = F.pmod("code", F.lit(64))
    some = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    profiles: dict[str, list[int]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], most: int = MOST, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of `docs` (which must have text; its columns stay, but for two of these names) with lang_pred and score.

    The distance of a text to a profile is the sum, over the text's most frequent n-grams, of how far the n-gram's rank
    is from its rank in the profile, or `most` where the profile lacks it. The least distance wins, ties to the smaller
    name; score is 1 minus that distance over the largest possible one. `und`, score 0: the text is null or has no
    letter, or nothing was learned. A very long text is read whole, in its batch's memory (some 200 bytes a character);
    repeated rows are judged each, alike. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    langs = sorted(profiles)
    kept = [c for c in docs.columns if c not in names]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    codes = np.array(sorted({c for p in profiles.values() for c in p}), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = np.full((len(langs), len(codes) + 1), 1 << 20, np.int32)
        for i, x in enumerate(langs):
            rank_of[i, np.searchsorted(codes, np.array(profiles[x], np.int64))] = np.arange(len(profiles[x]))
        for b in pieces_of(batches, "text", PART):
            n = b.num_rows
            doc, code, letters = grams(b.column("text").to_pylist())
            d, c, r = top_grams(doc, code, most)
            total = np.where(letters > 0, np.bincount(d, minlength=n), 0)
            best, which = np.full(n, np.inf), np.full(n, -1)
            at = np.searchsorted(codes, c)
            at[at < len(codes)] = np.where(codes[at[at < len(codes)]] == c[at < len(codes)], at[at < len(codes)], len(codes))
            for i in range(len(langs)):
                away = np.abs(rank_of[i, at] - r)
                dist = np.bincount(d, weights=np.where(away > most, most, away), minlength=n)
                better = (dist < best) & (total > 0)
                best[better], which[better] = dist[better], i
            found = which >= 0
            score = np.where(found, 1 - np.where(found, best, 0) / (most * np.maximum(total, 1)), 0.0)
            pred = [langs[w] if w >= 0 else "und" for w in which]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [f.name for f in schema.fields])

    return docs.select(*kept).mapInArrow(run, schema)


def learn(docs: DataFrame, most: int = MOST) -> dict[str, list[int]]:
    """Profiles from the rows of `docs` that are not held out and have a language."""
    return train_profiles(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))), most)


def op8_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Null texts are `und`; a null doc_id is not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = predict_languages(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
