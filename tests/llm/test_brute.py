"""Language, quality and the whole pipeline against plain versions of themselves."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docstrand.llm.op8_language import op8_language
from docstrand.llm.op10_quality import FEATURES, features, fit, score_quality

import brute

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "ἀρχὴ ἦν ὁ λόγος", "в начале было слово", "日本語のテキスト", "12 34 !!", "á́ ëx", "İ ǅ ẞ", "x" * 5000, "the | THE. 3?"]


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    more = [(10_000 + i, t, ("el", "ru", None)[i % 3], ("a/b", "a/c", None)[i % 3]) for i, t in enumerate(ODD)]
    return docs + more + [docs[3], docs[3], (docs[4][0], docs[5][1] + " more words here", "en", "a/b"), (None, docs[6][1], None, "")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, at int").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_languages_are_those_of_the_plain_version(rows, frame):
    found = brute.languages([x[:3] for x in rows])
    want = sorted((repr(r[0]), brute.held_out(r[0]), *found[i]) for i, r in enumerate(rows))
    got = sorted((repr(r.doc_id), r.held_out, r.lang_pred, r.score) for r in op8_language(frame).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_features_are_those_of_the_plain_version(rows):
    texts = [r[1] for r in rows]
    assert np.allclose(features(texts), [brute.features(t) for t in texts]) and len(FEATURES) == 9


def test_fit_is_the_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.random((300, 4)), rng.integers(0, 2, 300)
    weights, intercept = fit(x, y)
    z = np.column_stack([x, x * x])
    scale = np.maximum(z.std(axis=0), 1e-6)
    p = 1 / (1 + np.exp(-(intercept + z @ weights)))
    assert np.allclose(((z - z.mean(axis=0)) / scale).T @ (y - p), weights * scale, atol=1e-5) and abs((y - p).sum()) < 1e-4


def test_quality_is_that_of_the_plain_version(rows, frame, labels):
    known = {}
    for r in labels.where("doc_id is not null and quality is not null").collect():
        known[r.doc_id] = min(r.quality, known.get(r.doc_id, 1))
    want = sorted(zip(map(repr, (r[0] for r in rows)), brute.quality([(r[0], r[1], r[3]) for r in rows], known)))
    got = sorted((repr(r.doc_id), r.quality) for r in score_quality(frame, labels).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-5)


def test_quality_does_not_hang_on_the_order_of_rows(frame, labels):
    first, second = (sorted(map(repr, score_quality(x, labels).collect())) for x in (frame, frame.repartition(7).orderBy(F.rand(3))))
    assert first == second


def test_pipeline_is_that_of_the_plain_version(spark, rows, labels, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([r for r in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    known = {}
    for r in labels.where("doc_id is not null and quality is not null").collect():
        known[r.doc_id] = min(r.quality, known.get(r.doc_id, 1))
    found = brute.languages([x[:3] for x in rows])
    left = [r for i, r in enumerate(rows) if found[i][0] != "und" and found[i][1] >= pipeline.LANGUAGE_LEAST]
    left = [r for r, q in zip(left, brute.quality([(r[0], r[1], r[3]) for r in left], known)) if round(q, 6) >= pipeline.QUALITY_LEAST]
    left = sorted(set(left), key=repr)
    sets, union = [brute.shingles(r[1]) for r in left], brute.Union(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if left[a][0] is not None and left[b][0] is not None and brute.near(sets[a], sets[b]):
                union.join(a, b)
    texts = {}
    for i, r in enumerate(left):  # of a component one is kept, the least by doc_id
        texts.setdefault(union.find(i), []).append(r)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((repr(min((r[0] for r in x), key=lambda d: -1 if d is None else d)),) for x in texts.values())
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length == 4 * 2**p.bucket
        got.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()))
    assert sorted((repr(d),) for d, _ in got) == want
    candidates = {(r[0], tuple(tok.encode(r[1], add_special_tokens=False).ids) + (2,)) for r in left}
    for (d, _), parts in got.items():
        assert (d, tuple(sum((ids for _, ids in sorted(parts)), []))) in candidates
    assert pipeline.run(spark, _empty(spark, tmp_path)).count() == 0


def _empty(spark, tmp_path):
    folder = tmp_path / "empty"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_language_is_exact_on_one_random_text(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abc äßЖ字.") for _ in range(3000))
    rows = [(i, text[i * 100 :], ("x", "y")[i % 2]) for i in range(20)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in op8_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = brute.languages(rows)
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in range(20))
