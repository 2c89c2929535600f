"""Language identification, quality, URL reputation and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docstrand.llm import op4_urls
from docstrand.llm.op8_language import op8_language
from docstrand.llm.op10_quality import op10_quality, score_quality

WORDS = {
    "en": "the of and to in that is was for with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will".split(),
    "de": "der die und in den von zu das mit sich des auf nicht eine als auch es an werden aus er hat dass sie nach wird bei einer um noch wie einem einen so zum war haben nur oder aber vor zur".split(),
}
DOCS = "text string, doc_id long, lang string, source string, score string, kept string, host int"


def prose(lang, rng, n=60):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def language_rows():
    rng = random.Random(1)
    return [(prose(l, rng), i, l, "s", "c", "c", 1) for i, l in enumerate(rng.choice(("en", "de")) for _ in range(200))]


def test_language(spark):
    rows = language_rows() + [(None, 900, "en", None, "", "", 0), ("", 901, "en", None, "", "", 0), ("12 !! 34", 902, None, None, "", "", 0), ("the", None, None, None, "", "", 0)]
    rows += [("den der " * 30_000, 903, None, None, "", "", 0), rows[0], ("日本語", 904, None, None, "", "", 0)]
    got = op8_language(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for text, i, lang, *_ in language_rows():
        r = by_id[i]
        assert r.lang_pred == lang and 0 < r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    for i in (900, 901, 902):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0
    assert by_id[None].lang_pred == "en" and not by_id[None].held_out
    assert by_id[903].lang_pred == "de" and by_id[904].lang_pred in ("en", "de")
    assert op8_language(spark.createDataFrame([], DOCS)).count() == 0
    unlabelled = spark.createDataFrame([("some text", 1, None, None, "", "", 0)], DOCS)
    assert op8_language(unlabelled).first().lang_pred == "und"


def test_held_out_language_is_not_learned(spark):
    rows = [(t, i, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else l, s, a, b, c) for t, i, l, s, a, b, c in language_rows()]
    assert {r.lang_pred for r in op8_language(spark.createDataFrame(rows, DOCS)).collect()} == {"en", "de"}


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op8_language(df).where("held_out").join(df.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_quality_accuracy_and_sites(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    # labels of the other half are not seen
    seen = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    truth = labels.join(seen, "doc_id", "left_anti").select("doc_id", (F.col("quality") == 1).alias("good"))
    rows = score_quality(df, seen).join(truth, "doc_id").select("kept", "good").collect()
    assert len(rows) > 100 and sum(r.kept == r.good for r in rows) >= 0.97 * len(rows)


def test_quality_edges(spark):
    rng = random.Random(2)
    rows = [(prose("en", rng), i, "en", "good.org/a", "", "", 0) for i in range(40)] + [("SPAM!! " * 40, 100 + i, "en", "bad.org/b/c", "", "", 0) for i in range(40)]
    rows += [(None, 200, None, None, "", "", 0), ("", 201, None, "", "", "", 0), ("x " * 50_000, None, None, "good.org", "", "", 0), rows[0]]
    labels = spark.createDataFrame([(i, 1, None) for i in range(0, 40, 2)] + [(100 + i, 0, 1) for i in range(0, 40, 2)] + [(0, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    got = op10_quality(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 200:
            assert r.kept == (r.doc_id < 100) and (r.host, r.path) == (("good.org", "a") if r.doc_id < 100 else ("bad.org", "b"))
        assert 0 <= r.quality <= 1
    assert op10_quality(docs.limit(0), labels).count() == 0
    assert {r.p_doc for r in op10_quality(docs, labels.limit(0)).collect()} == {0.5}


URLS = [
    "http://A.Example.ORG/es/x", "https://example.org/en/12?q#f", "http://notexample.org/es/", "http://org/", "http://example.org", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/DE/1",
    None, "no scheme", "", "ftp://host.net:80/p#/de/", "http://bad.net/1", "http://bad.net/2", "http://good.net/1", "http://sub.shop.co.uk/a", "x://y://z/w", "http://?a", "http://Ä.net/ü\nb", "http://long.net/" + "p" * 100_000 + "?" + "q" * 100_000, "http://10.0.0.7/a", "http://11.0.0.7:80/a",
]


def url_tables(spark):
    pages = [(u, i, "clash", 1) for i, u in enumerate(URLS)] + [(URLS[0], 0, "again", 1), ("http://bad.net/3", None, "", 1)]
    pages += [("http://bad.net/x", 100 + i, "", 1) for i in range(60)] + [("http://good.net/x", 200 + i, "", 1) for i in range(60)]
    labels = [(100 + i, 0, 0) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)] + [(12, 1, 1), (14, None, None), (None, 0, 0), (12, 1, 0), (10_000, 0, 0)]
    return spark.createDataFrame(pages, "url string, page_id long, host string, verdict int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_urls(spark):
    pages, labels = url_tables(spark)
    got = op4_urls.op4_host_reputation(pages, labels).collect()
    assert len(got) == pages.count()
    by_id = {r.page_id: r for r in got}
    assert [by_id[i].rule for i in range(8)] == ["example.org/es/", "example.org/en/1", "org/", "org/", None, "com/fr/", "com/de/", None]
    assert [by_id[i].verdict for i in range(8)][:4] == ["block", "block", "allow", "allow"]
    assert (by_id[0].host, by_id[0].path) == ("a.example.org", "/es/x") and (by_id[11].host, by_id[11].path) == ("host.net:80", "/p")
    assert {(by_id[i].host, by_id[i].path) for i in (8, 9, 10, 17)} == {("", "")} and by_id[16].host == "y:"
    assert by_id[13].verdict == "block" and by_id[14].verdict == "allow" and by_id[None].verdict == "block"
    assert by_id[18].path == "/ü\nb"
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    con.register("labels", labels.toArrow())
    want = con.sql(op4_urls.oracle())
    cols = want.columns
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in got)
    assert op4_urls.op4_host_reputation(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in op4_urls.op4_host_reputation(pages.where("page_id in (4, 7)"), labels.limit(0)).collect()} == {"allow"}


def test_levels(spark):
    hosts = ["a.b.example.com", "example.com", "com", "", "x.shop.co.uk", "shop.co.uk:8080", "10.0.0.7", "192.168.0.7:80"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").withColumns(op4_urls.levels(F.col("host"))).collect()
    assert [(r.domain, r.suffix) for r in rows] == [("example.com", "com"), ("example.com", "com"), ("com", "com"), ("", ""), ("shop.co.uk", "co.uk"), ("shop.co.uk", "co.uk"), ("10.0.0.7", "10.0.0.7"), ("192.168.0.7:80", "192.168.0.7:80")]


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    rows = [(prose("en", rng), i, "en", "good", i) for i in range(60)] + [("SPAM!! " * 40, 100 + i, "en", "bad", 0) for i in range(30)]
    rows += [(rows[1][0], 300, "en", "good", 0), (rows[1][0] + " and", 301, "en", "good", 0), ("12 34 !!", 302, "en", "good", 0), (None, 303, None, None, 0), rows[2], (prose("en", rng), None, None, None, 0)]
    schema = "text string, doc_id long, lang string, source string, pipeline_clash int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 3 or out.columns == docs.columns
        sizes.append(sorted(str(r.doc_id) for r in out.select("doc_id").collect()))
        docs = out
    assert not {"302", "303"} & set(sizes[0]) and len(sizes[0]) == len(rows) - 2
    assert set(sizes[1]) == {str(i) for i in range(60)} | {"300", "301", "None"}
    assert sizes[2] == sorted([str(i) for i in range(60)] + ["None"])
    assert set(sizes[3]) == set(sizes[2])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(sizes[3])


def test_texts_of_one_id_are_documents_of_their_own(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    a, b, c, d = (prose("en", rng) for _ in range(4))
    rows = [(a, 1), (b, 2), (a, 2), (c, 3), (d, 3), (c, 3), (b + " and", 5), (d, 0), (None, 4), (c, None)]
    docs = spark.createDataFrame([(t, i, "x") for t, i in rows], "text string, doc_id long, source string")
    left = [(r.text, r.doc_id) for r in corpus_pipeline.near_duplicate(spark, docs, "").collect()]
    assert sorted(left, key=repr) == sorted([(a, 1), (b, 2), (c, 3), (d, 0), (None, 4), (c, None)], key=repr)


def test_packing_stage_writes_ids(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    docs = spark.createDataFrame([(prose("en", rng), i) for i in range(5)] + [(None, 5)], "text string, doc_id long")
    corpus_pipeline.packing(spark, docs, "").write.parquet(str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    assert {r.doc_id for r in rows} == set(range(6))
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for text, i in docs.collect():
        whole = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start))
        assert np.frombuffer(whole, "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_registry():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
