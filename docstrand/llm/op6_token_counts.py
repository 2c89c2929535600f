"""Token counts without ids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrand.llm.common import pieces_of, ship
from docstrand.llm.pieces import BYTE_LEVEL, PLAIN, REMEMBERED, ByteLevel, library_ids, memory, tokenizer, vocabulary_path


class Splitter:
    """Frequencies of a text's pre-tokens; special strings stay whole, as the library cuts them out first."""

    def __init__(self, path: str):
        tok = tokenizer(path)
        self.library, self.pieces = tok.pre_tokenizer.pre_tokenize_str, ByteLevel()
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alike: dict[str, bool] = {}

    def agrees(self, text: str) -> bool:
        """Whether the library classes each character as our pattern does."""
        new = set(text).difference(self.alike)
        for c in new:
            probe = f"a{c}1{c}!{c}"
            self.alike[c] = len(self.pieces.any.findall(probe)) == len(self.library(probe))
        return all(map(self.alike.__getitem__, set(text))) if len(self.alike) > sum(self.alike.values()) else True

    def __call__(self, text: str) -> Counter:
        if not PLAIN.fullmatch(text) and not self.agrees(text):
            return Counter([text])
        if self.cut is None or not self.cut.search(text):
            return Counter(self.pieces(text))
        out: Counter = Counter()
        for part in self.cut.split(text):
            out.update([part] if part in self.special else self.pieces(part))
        return out


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Each batch of documents is reduced to per-document frequencies of its pre-tokens. The pieces of each distinct one are
    counted once by the library for the batches that a worker remembers it in; the frequencies are joined to the counts
    inside the task and summed. No id of a document is kept, and nothing is shuffled. A join across tasks, so that a pre-token
    is counted once in all, moves about as many rows as the corpus has words: it took 4.5 times the input of disk.

    A text with a character that the library's pattern classes otherwise than ours (another Unicode version) is encoded
    whole. A very long text is split whole, in its batch's memory. A null text counts as empty: 0 bytes, 0 tokens. Repeated
    rows are counted each. Special strings inside a text are one token, as the library does by default. An empty table gives
    no rows. Other columns of `docs` are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            ids = library_ids(vocabulary_path(vocabulary), BYTE_LEVEL, False)
            return lambda items: [len(x) for x in ids(items)]

        known, split = memory(("counts", vocabulary), make, REMEMBERED), Splitter(vocabulary_path(vocabulary))
        for b in pieces_of(batches, "text", remember=True):
            texts = [x or "" for x in b.column("text").to_pylist()]
            frequencies = [split(x) for x in texts]
            count = known.learn(frequencies)
            n = [sum([k * count[w] for w, k in f.items()]) for f in frequencies]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
