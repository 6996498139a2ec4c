import math
from collections import Counter

import numpy as np
import pytest

from windloom.operators import evidence, graph, retrieval
from windloom.plans import registry

DOCS = [(1, "lift drag lift"), (2, "drag wing"), (3, "tail wing span wing"), (4, "span"), (5, None), (6, "")]


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    words = {i: (t or "").split() for i, t in docs}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    usual = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else eps * usual for t, r in raw.items()}
    return {i: sum(idf.get(t, 0) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / mean)) for t in query.split()) for i, w in words.items()}


def test_bm25_equals_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = spark.createDataFrame([(100, "lift wing"), (101, "lift lift"), (102, "nothing"), (103, None)], "doc_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25(docs, asked).collect()}
    for q, text in ((100, "lift wing"), (101, "lift lift")):
        for i, want in okapi(DOCS, text).items():
            assert got.get((q, i), 0) == pytest.approx(want, abs=2e-6)
    assert not any(q > 101 for q, _ in got)


def test_fusion_fixture(spark):
    rank = lambda ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids)], "query_id long, doc_id long, rank int")
    got = {r["doc_id"]: r["score"] for r in retrieval.fuse(rank([1, 2, 3]), rank([2, 4, 1])).collect()}  # a, b, c = 1, 2, 3; d = 4
    assert got == pytest.approx({2: 0.01648907, 1: 0.01647849, 3: 0.01048387, 4: 0.0057377}, abs=1e-8)


def test_dense_mmr_and_dedup(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[10] = x[11]
    vectors = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    near = retrieval.dense(vectors, vectors.filter("vec_id < 5"), 6)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(5):
        want = [i for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:6]
        assert [r["vec_id"] for r in near.filter(f"query_id = {q}").orderBy("rank").collect()] == want
    assert retrieval.dense(vectors, vectors.limit(0)).count() == 0
    plain = retrieval.mmr(near, vectors, weight=1.0, k=6)  # relevance alone
    assert {tuple(r) for r in plain.collect()} == {(r["query_id"], r["vec_id"], r["rank"]) for r in near.collect()}
    kept = evidence.greedy_dedup(near, vectors, 0.999)
    again = evidence.greedy_dedup(kept, vectors, 0.999)
    assert kept.count() == again.count()


def test_similarity_edges_have_no_limit(spark):
    x = np.random.default_rng(2).normal(size=(400, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["src"], r["dst"]): r["similarity"] for r in graph.similarity_edges(vectors, vectors.filter("vec_id < 3"), 0.25).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u[:3] @ u.T, 6)
    want = {(q, d): sim[q, d] for q in range(3) for d in range(400) if q != d and sim[q, d] > 0.25}
    assert got == pytest.approx(want, abs=2e-6) and len(want) > 150
    assert graph.similarity_edges(vectors, vectors.limit(0)).count() == 0


def test_hops_against_brute_force(spark):
    rng = np.random.default_rng(1)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 40, (45, 2)) if a != b}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    df = spark.createDataFrame([(a, b, 0.9) for a, b in edges], "src long, dst long, similarity double")
    got = {(r["seed"], r["node"]): r["hop"] for r in graph.hops(df, spark.createDataFrame([(3,), (3,), (7,)], "node long"), 2).collect()}
    want = {}
    for s in (3, 7):
        front, want[s, s] = {s}, 0
        for k in (1, 2):
            front = {n for f in front for n in near.get(f, ())}
            for n in front:
                want.setdefault((s, n), k)
    assert got == want


def test_word_budget_and_citations(spark):
    rows = [(1, "a", 0, "one two three"), (1, "a", 1, "four five"), (2, "a", 0, "six seven"), (3, "b", 0, "x y"), (4, None, 0, "z")]
    facts = spark.createDataFrame(rows, "doc_id long, source string, pos int, fact string")
    got = sorted(tuple(r) for r in evidence.word_budget(facts.filter("source is not null"), 4).collect())
    assert got == [("a", 1, 0, 3, "one two three"), ("a", 1, 1, 1, "four"), ("b", 3, 0, 2, "x y")]
    assert [(r["source"], r["number"]) for r in evidence.citation_numbers(facts).orderBy("number").collect()] == [("a", 1), ("b", 2)]


def test_contradiction_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(evidence, "WORD_ROWS", 5)
    rng = np.random.default_rng(3)
    texts = ["The wing does not stall at 12 degrees", "the wing stalls at 12 degrees", "The wing does stall at 14 degrees", "no no no", ""]
    for _ in range(150):
        w = [f"w{k}" for k in rng.integers(0, 12, rng.integers(6, 14)) ** 2 // 12]
        texts += [" ".join(w), " ".join([*w[:3], "not", *w[3:], *(["w1"] if rng.random() < 0.5 else [])])]
    texts += texts[:40]
    rows = spark.createDataFrame([(t,) for t in texts], "fact string")
    got = {(r["plain"], r["opposed"]): (r["similarity"], r["n_plain"], r["n_opposed"]) for r in evidence.contradiction_pairs(rows).collect()}
    n = Counter(t.lower() for t in texts if t)
    want = {}
    for p in n:
        for q in n:
            a, b = Counter(p.split()), Counter(q.split())
            if not {"not", "no"} & set(a) and {"not", "no"} & set(b):
                cosine = sum(a[w] * b[w] for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                if round(cosine, 6) >= 0.82:
                    want[p, q] = (pytest.approx(cosine, abs=1e-6), n[p], n[q])
    assert got == want and len(want) > 150
    assert evidence.contradiction_pairs(spark.createDataFrame([], "fact string")).count() == 0


def test_contradiction_pairs_shuffle_no_candidates(spark, monkeypatch):
    texts = [f"the load of rig {k} rose" if k % 2 else f"the load of rig {k} is the load" for k in range(600)]  # many meet, few are alike
    rows = spark.createDataFrame([(t,) for t in texts], "fact string")
    few = evidence.contradiction_pairs(rows)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(evidence, "BLOCK_BYTES", 4000)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(few) == key(evidence.contradiction_pairs(rows))


@pytest.mark.parametrize("common", [1, 3, 48])
def test_few_opposed_statements_are_compared_word_by_word(monkeypatch, common):
    rng = np.random.default_rng(8)
    frames = [[1000 * f + k for k in rng.integers(0, 12, 14)] for f in range(8)]  # templates and what they are filled with
    said = [np.array(frames[k % 8] + [9000 + x for x in rng.integers(0, 40, 6)], np.int64) for k in range(800)]
    opposed, plain, compared = said[:400], [*said[400:], np.array([77_777]), said[0]], []
    monkeypatch.setattr(evidence, "SKELETON_WORDS", common, raising=False)
    index = evidence._Opposed(opposed, 0.82)
    products = index.products
    monkeypatch.setattr(index, "products", lambda met, has: compared.append(len(met)) or products(met, has))
    got = {(p, int(q)): c for p, met, cosines in index.similar(np.concatenate(plain), np.array([len(w) for w in plain])) for q, c in zip(met, cosines)}
    want = {}
    for p, a in enumerate(map(Counter, (w.tolist() for w in plain))):
        for q, b in enumerate(map(Counter, (w.tolist() for w in opposed))):
            cosine = sum(a[w] * b[w] for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            if cosine >= 0.82:
                want[p, q] = pytest.approx(cosine)
    assert got == want and len(want) > 1000
    assert common < 48 or sum(compared) < 1.2 * len(want)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_numbers_follow_the_order_over_partitions(spark):
    rows = spark.createDataFrame([(int(x), str(k)) for k, x in enumerate(np.random.default_rng(4).permutation(500))], "v long, s string").repartition(7)
    got = evidence.numbered(rows, "v").collect()
    assert all(r["number"] == r["v"] + 1 for r in got) and len(got) == 500
    assert evidence.numbered(rows.limit(0), "v").count() == 0


def test_gates(spark):
    asked = spark.createDataFrame([(1, "wing flutter margin"), (2, None)], "query_id long, text string")
    held = spark.createDataFrame([(1, "the flutter margin of the wing")], "query_id long, fact string")
    offered = [(1, k, f) for k, f in enumerate(["flutter margin of the wing", "wing flutter", "flutter onset", "spar caps", *(["wing margin"] * 8)])]
    got = evidence.gated(asked, held, spark.createDataFrame(offered, "query_id long, place long, fact string"), known=0.97)
    assert sorted(r["place"] for r in got.collect()) == [0, 1, 4, 5, 6, 7]
    strict = evidence.gated(asked, held, spark.createDataFrame(offered, "query_id long, place long, fact string"), known=0.7)
    assert 0 not in {r["place"] for r in strict.collect()}


def test_upserts_and_routes(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [0.0, 1.0], 6), (100, [0.9, 0.1], 5), (200, [-1.0, 0.2], 5), (300, [0.0, 0.0], 6)], "vec_id long, embedding array<double>, label int")
    new = vectors.filter("vec_id >= 100")
    assert {r["vec_id"]: r["node"] for r in graph.upserted(vectors, new).collect()} == {100: 1, 200: 200, 300: 300}
    routed = graph.route(new, graph.centroids(vectors.filter("vec_id < 100")), least=0.5)
    assert {r["vec_id"]: r["routed"] for r in routed.collect()} == {100: 5, 200: None, 300: None}


def test_merge_and_first_sources(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, value long"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, value long")
    assert {tuple(r) for r in evidence.merge_right(left, right, "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    rows = spark.createDataFrame([(2, "x", 0, "f"), (1, "y", 3, "f"), (1, None, 1, "g")], "doc_id long, source string, pos int, fact string")
    assert {tuple(r) for r in evidence.first_sources(rows).collect()} == {("f", "y"), ("g", None)}
