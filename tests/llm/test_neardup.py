"""Near duplicates, vectors and search against brute force."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from docstrand.llm import components as components_module
from docstrand.llm.components import components
from docstrand.llm.op1_ann import hadamard, nearest
from docstrand.llm.op2_vector_dedup import MISS, near_vectors, pass_chance, passes_for
from docstrand.llm.op5_minhash import COORDINATES, MATCHES, PREFIX, Members, near_duplicates, op5_minhash
from pyspark.sql import functions as F

SCHEMA = "text string, doc_id long, component_id string, n_shingles int"


class Union:
    def __init__(self, ids):
        self.of = {i: i for i in ids}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def shingles(text):
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(25))
    base = [[word() for _ in range(rng.choice((8, 60, 150)))] for _ in range(40)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two", "a b c d", "a b c d", "A  b\nC d e", "x " * 5, "x " * 9]
    texts += [" ".join(b) for b in base] + [passage + " " + " ".join(b[:20]) for b in base]
    for _ in range(150):  # copies of one text with more and fewer edits, so that some link only through others
        b = base[1][:] if rng.random() < 0.6 else rng.choice(base)[:]
        for _ in range(rng.choice((0, 1, 2, 4, 8))):
            b[rng.randrange(len(b))] = word()
        texts.append(" ".join(b))
    return texts + ["long " + " ".join(word() for _ in range(20_000))]


def test_minhash_is_exact_here(spark):
    texts = corpus()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    rows = [(texts[i], i + 7, "clash", 0) for i in order]
    got = op5_minhash(spark.createDataFrame(rows + [rows[5], ("null id", None, None, None)], SCHEMA)).collect()
    sets = {i + 7: shingles(t) for i, t in enumerate(texts)}
    want = Union(sets)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                want.join(a, b)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want.find(r.doc_id), want.find(r.doc_id) == r.doc_id)


def test_minhash_empty(spark):
    assert op5_minhash(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.kept for r in op5_minhash(spark.createDataFrame([(None, 1, "", 0)], SCHEMA)).collect()] == [True]


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001 + i) for i in range(100)] + [(5, 5)]
    want = Union({x for p in pairs for x in p})
    for p in pairs:
        want.join(*p)
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    alone = {x for x in want.of if want.find(x) == x and sum(want.find(y) == x for y in want.of) == 1}
    assert got == {x: want.find(x) for x in want.of if x not in alone}
    monkeypatch.setattr("docstrand.llm.components.TASK_LINKS", 0)  # the rounds alone
    assert got == {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "label int, embedding array<float>, vec_id long, n_links string, score string"


def vectors():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1):
        centre = rng.standard_normal(16)
        for spread, count in ((0.02, 60), (0.09, 60), (2.0, 60)):
            for _ in range(count):
                rows.append((label, (centre + spread * rng.standard_normal(16)).astype(np.float32).tolist(), n, "c", "c"))
                n += 1
    rows += [(0, rows[0][1], n, "", ""), (1, rows[0][1], n + 1, "", ""), (None, rows[0][1], n + 2, "", "")]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(0, x, n + 3 + i, "", "") for i, x in enumerate(bad)] + [(0, [3.0 * v for v in rows[3][1]], n + 20, "", ""), (0, rows[3][1][:8], n + 21, "", ""), (0, rows[4][1], None, "", "")]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_links_are_made_and_reduced_by_tasks_of_their_own(spark, monkeypatch):
    """A task that does both has two Python workers, and an executor twice as many as it has cores."""
    plans, forest = [], components_module.forest

    def seen(links, *rest, **more):
        plans.append(links._jdf.queryExecution().toString())
        return forest(links, *rest, **more)

    monkeypatch.setattr(components_module, "forest", seen)
    texts = [" ".join(f"w{i // 3}x{k}" for k in range(40)) + " end" * (i % 3) for i in range(12)]
    docs = spark.createDataFrame([(t, i, None, 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r.component_id for r in near_duplicates(docs).collect()} == {0, 3, 6, 9}
    assert len(plans) >= 6
    vectors = spark.createDataFrame([(i, [1.0, i / 100], 1) for i in range(4)], "vec_id long, embedding array<double>, label int")
    assert {(r.component_id, r.n_links) for r in near_vectors(vectors).collect()} == {(0, 3)}
    assert len(plans) >= 8 and not [p for p in plans if "InArrow" in p]


def test_vector_links_are_exact_here(spark):
    rows = vectors()
    order = rows[:]
    random.Random(5).shuffle(order)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(order, VECTORS)).collect()}
    assert len(got) == len(rows)
    good = [(l, np.array(v, float), i) for l, v, i, *_ in rows if l is not None and i is not None and usable(v)]
    want, links = Union([r[2] for r in rows if r[2] is not None]), {r[2]: 0 for r in rows}
    for a, (l, x, i) in enumerate(good):
        for m, y, j in good[a + 1 :]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                links[i] += 1
                links[j] += 1
                want.join(i, j)
    for i, r in got.items():
        if i is not None:
            assert (r.n_links, r.component_id, r.kept) == (links[i], want.find(i), want.find(i) == i), i
    assert got[None].kept and got[None].n_links == 0
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_isolated_vector_pairs_in_a_large_label(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((30_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((1000, 64))
    side -= (side * x[:1000]).sum(axis=1, keepdims=True) * x[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = np.float32(np.concatenate([x, 0.9302 * x[:1000] + np.sqrt(1 - 0.9302**2) * side]))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(31_001) * 64, pa.int32()), pa.array(near.ravel()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(31_000)), "label": pa.array(np.zeros(31_000, np.int32)), "embedding": flat}), tmp_path / "v.parquet")
    got = near_vectors(spark.read.parquet(str(tmp_path / "v.parquet")).repartition(4))
    joined = got.where("vec_id >= 30000 and component_id = vec_id - 30000 and n_links = 1 and not kept").count()
    assert joined >= 1000 - 4  # a miss of 1 in 1000 at most is asked for
    assert got.count() == 31_000 and got.where("n_links > 0").count() == 2 * joined


def test_passes_grow_with_the_largest_label():
    assert [passes_for(n) for n in (0, 25, 1000)] == [12, 12, 12]
    for n in (30_000, 10**6, 10**9):
        chance = pass_chance(n, 24, 0.93)
        assert (1 - chance) ** passes_for(n) <= MISS < (1 - chance) ** (passes_for(n) - 1)


def test_search_finds_the_nearest(spark):
    rows = vectors() + [(0, [50.0 * v for v in vectors()[70][1]], 900, "", "")]
    got = {}
    for r in nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(np.array(v, float), i) for _, v, i, *_ in rows if i is not None and usable(v)]
    hits = total = 0
    for q, i in good:
        if i % 20:
            continue
        want = sorted(((-(q * x).sum(), j) for x, j in good if j != i and len(x) == len(q)))[:10]
        found = sorted(got.pop(i))
        assert [k for k, *_ in found] == list(range(1, len(want) + 1))
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        hits += len({j for _, j, _ in found} & {j for _, j in want})
        total += len(want)
    assert not got and hits >= 0.9 * total
    assert nearest(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    few = spark.createDataFrame(rows[:4], VECTORS)
    assert nearest(few, F.col("vec_id") == 0).count() == 3


def test_search_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    p = df.toPandas()
    x, ids = np.array(p.embedding.tolist(), float), p.vec_id.to_numpy()
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = [len(got[i] & set(ids[[j for j in np.argsort(-(x @ x[k])) if j != k][:20]])) / 20 for k, i in enumerate(ids) if i % 20 == 0]
    assert np.mean(recall) >= 0.9


def test_hadamard():
    x = np.random.default_rng(0).standard_normal((3, 8))
    assert np.allclose(hadamard(hadamard(x)), x) and np.allclose((hadamard(x) ** 2).sum(1), (x**2).sum(1))




def test_texts_and_repeats_of_one_id(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    a, b, c = ([word() for _ in range(80)] for _ in range(3))
    text = " ".join
    rows = [(text(a), 1), (text(b), 1), (text(b[:79] + ["x"]), 5), (text(a[:79] + ["y"]), 3), (text(c), 7), (text(c), 7), (text(c), 9), (text(c[:78] + ["z"]), 7), (text(a), 0)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op5_minhash(spark.createDataFrame([(t, i, "", 0) for t, i in rows], SCHEMA)).collect()}
    assert got == {(1, 76, 0, False), (1, 76, 1, True), (5, 76, 1, False), (3, 76, 0, False), (7, 76, 7, True), (9, 76, 7, False), (7, 75, 7, True), (0, 76, 0, True)}
    leads = [(r.doc_id, r.leads) for r in near_duplicates(spark.createDataFrame(rows, "text string, doc_id long")).collect()]
    assert sum(l for _, l in leads) == 4  # two of the three rows of 7 and c, which are repeats, lead with it


def test_repeated_rows_cost_no_comparisons(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(3)]
    texts[1] = texts[0] + " tail"
    took = []
    for n in (1, 3000):
        rows = spark.createDataFrame([(t, i, "", 0) for i, t in enumerate(texts)], SCHEMA).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("n").repartition(3)
        began = time.monotonic()
        got = {(r.doc_id, r.component_id) for r in op5_minhash(rows).collect()}
        took.append(time.monotonic() - began)
        assert got == {(0, 0), (1, 0), (2, 2)}
    assert took[1] < 2 * took[0] + 5


def test_collisions_are_counted_exactly():
    rng = np.random.default_rng(4)
    n = 60
    sig = rng.integers(0, 3, (n, COORDINATES)).astype(np.int32)
    sig[30:] = sig[:30]
    sig[30:][rng.random((30, COORDINATES)) < 0.3] = 7
    coords = [rng.permutation(COORDINATES).astype(np.int8) for _ in range(1)] * n
    t = pa.table({
        "node": pa.array(range(n), pa.int64()), "component": pa.array(range(n), pa.int64()), "side": pa.array([0] * n, pa.int32()), "rest": [True] * n, "at": pa.array([0] * n, pa.int8()),
        "sig": pa.array(list(sig), pa.list_(pa.int32())), "coords": pa.array(coords, pa.list_(pa.int8())), "prefix": pa.array([PREFIX] * n, pa.int32()),
    })
    both = pa.concat_tables([t, t.set_column(2, "side", pa.array([1] * n, pa.int32()))])
    got = {(min(a % n, b % n), max(a % n, b % n)): m for x, y, z in Members(both).collisions(False) for a, b, m in zip(x, y, z)}
    want = {(a, b): m for b in range(n) for a in range(b) if (m := int((sig[a] == sig[b]).sum())) >= MATCHES}
    assert got == want and len(want) > 20


def test_one_vector_id_under_labels_and_dimensions(spark):
    x, y = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    rows = [(0, x, 1, "", ""), (1, x, 1, "", ""), (0, y, 3, "", ""), (1, [0.0, 1.0, 0.0], 4, "", ""), (0, [1.0, 0.0], 1, "", ""), (0, [1.0, 0.0], 8, "", ""), (1, [1.0, 0.05, 0.0], 0, "", "")]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 1, True), (1, 1, 1, True), (3, 1, 1, False), (4, 0, 4, True), (8, 1, 1, False)]


def test_search_in_few_dimensions_and_with_repeated_ids(spark):
    for dim in (1, 2, 3):
        rng = np.random.default_rng(dim)
        x = rng.standard_normal((60, dim)).astype(np.float32)
        rows = [(0, v.tolist(), i, "", "") for i, v in enumerate(x)]
        got = {}
        for r in nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=5).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        y = x.astype(float)
        for q in (0, 20, 40):
            assert [(i, s) for _, i, s in sorted(got[q])] == [(j, s) for s, j in sorted((((y[q] * y[j]).sum(), j) for j in range(60) if j != q), key=lambda p: (-p[0], p[1]))[:5]]
    rows += [(0, [9.0, 9.0, 9.0], 20, "", ""), (0, [-9.0, 0.0, 0.0], 20, "", ""), (0, [1.0, 1.0], 21, "", "")]
    several = [sorted(map(repr, nearest(spark.createDataFrame(rows, VECTORS).repartition(n), F.col("vec_id") % 20 == 0, k=5).collect())) for n in (1, 7)]
    assert several[0] == several[1]
    assert nearest(spark.createDataFrame([(0, [1e300, 1e300], 0, "", ""), (0, [1e300, 1e300], 1, "", "")], VECTORS.replace("array<float>", "array<double>")), F.lit(True)).count() == 2
