import math
import random
import re

import numpy as np
import pytest
from tests_llm_helpers import SCHEMA, awkward
from pyspark.sql import functions as F

from tablewarden.llm import lexical_search, vector_search, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors_of(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims))
    rows = [(i, (centres[i % 5] + 0.6 * rng.standard_normal(dims)).astype(np.float32).tolist(), i % 5) for i in range(n)]
    return [(i, rows[0][1] if i % 7 == 0 and copies else v, k) for i, v, k in rows] + rows[3:4] * copies


def nearest(rows, step, k=5):
    """Brute force of op11: lists of (query, rank, id, score)."""
    ints = {(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, _ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for q, x in ints:
        if q % step == 0:
            hits = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints if (i, y) != (q, x))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "copies"), [(900, 12, 3), (400, 3, 40), (4, 8, 0), (1, 8, 0)])
def test_nearest_vectors_match_brute_force(spark, monkeypatch, n, dims, copies):
    monkeypatch.setattr(vector_search, "BLOCK", 64)  # many blocks, so that thresholds are carried
    monkeypatch.setattr(vector_search, "QUERIES", 20)
    monkeypatch.setattr(vector_search, "TILE", 8)
    monkeypatch.setattr(vector_search, "SAMPLE", 50)
    rows = vectors_of(n, dims, n, copies)
    got = vector_search.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == nearest(rows, 10)


def test_most_vectors_are_not_read_exactly():
    rng = np.random.default_rng(3)
    centres = rng.integers(-120, 120, (40, 16))
    x = centres[rng.integers(0, 40, 4000)] + rng.integers(-12, 12, (4000, 16))
    edges = np.quantile(x, np.arange(1, 64) / 64, axis=0, method="lower").T.copy()
    cells = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1).astype(np.uint8)
    low, high = vector_search.bounds(x[:20], cells, x, edges)
    true = x[:20] @ x.T
    assert (low <= true).all() and (true <= high).all()
    best = vector_search.Best(20, 6, 6)
    ids = np.column_stack((np.ones(4000, np.int64), np.arange(4000)[:, None].repeat(6, 1)))
    read = vector_search.search_block(best, x[:20], cells, x, np.zeros(4000, np.int64), ids, edges)
    assert read < 20 * 4000 / 20
    for q in range(20):
        assert sorted(best.score[best.q == q]) == sorted(np.sort(true[q])[-6:])


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None, 1), (901, [], 1), (902, [1.0, None, 0.0], 1), (903, [nan, 0.0, 0.0], None), (904, [0.0, -inf, 0.0], 1), (None, [1.0, 1.0, 1.0], 1), (905, [1.0, 2.0], 1)]
    some = [(i, [i / 9, -i / 7, 0.25], 0) for i in range(40)] + [(10, [5.0, 5.0, 5.0], 0), (20, [20 / 9, -20 / 7, 0.25], 0)]
    docs = spark.createDataFrame(odd + some, VECTORS).withColumns({c: F.lit("x") for c in ("h", "v", "score", "rank", "salt", "query_id", "component", "n")})
    got = vector_search.top_k(docs, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == nearest(some, 10)
    white = whitening.whitened(docs).collect()
    assert {r["vec_id"] for r in white} == {*range(40), None} and {r["n"] for r in white} == {43}
    for empty in (docs.limit(0), docs.where("vec_id IN (900, 903)")):
        assert vector_search.top_k(empty, F.col("vec_id") % 10 == 0).collect() == [] and whitening.whitened(empty).collect() == []
    assert whitening.whitened(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], VECTORS)).collect() == []


def test_huge_components(spark):
    rows = [(i, [1e38 * (i + 1), -3.0, 1e30 * (-1) ** i], 0) for i in range(3)] + [(i, [1.0, i / 3, 0.5], 0) for i in range(3, 30)]
    got = vector_search.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).where("query_id = 10").collect()
    hold = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    ints = {i: [hold(math.floor(256 * float(np.float32(c)))) for c in v] for i, v, _ in rows}
    want = sorted((-hold(sum(a * b for a, b in zip(ints[10], x))), i) for i, x in ints.items() if i != 10)[:5]
    assert [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(-s, i) for s, i in want]
    assert len({r["vec_id"] for r in whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()}) == 30


def ranked(docs, items, k=10):
    """Brute force of op12."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(r[0], split(r[1])) for r in docs]
    texts = [(i, w) for i, w in texts if w]
    n_docs, n_terms = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, text in items:
        asked.setdefault(i, []).extend(split(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, w in texts:
            m = 100 - 75 + 75 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in df)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_documents_match_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 2000)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 400)
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "the", "Ünï", "x1", "Σ"]) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.6)) % 300}"
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60)), "en", "s", 0) for i in range(150)]
    docs += [(1000 + i, docs[4][1], "en", "s", 0) for i in range(30)] + awkward(500)
    items = [(i, text(rng.randint(0, 12))) for i in range(25)] + [(3, text(5)), (None, text(4)), (77, None), (78, "nosuchword"), (79, docs[4][1])]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("item_id", "term", "score", "block", "n")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "term", "score", "block", "n")})
    got = lexical_search.search(frame, asked).collect()
    assert sorted(map(tuple, got), key=str) == ranked(docs, items)
    assert lexical_search.search(frame.limit(0), asked).collect() == [] and lexical_search.search(frame, asked.limit(0)).collect() == []


def test_probes_skip_documents_that_cannot_qualify():
    n = 3000
    places = {0: np.array([5, 9]), 1: np.arange(n)}  # a rare term of high weight, a common one of low weight
    row = {"docs": np.arange(n), "known": np.ones(n, "u1"), "terms": np.array([0, 1], "<i4"), "counts": np.array([2, n], "<i4"), "lengths": np.full(n, 100), "places": np.concatenate(list(places.values())).astype("<i4"), "tfs": np.ones(n + 2, "<u4")}
    shard = lexical_search.Shard({k: v.tobytes() for k, v in row.items()}, n, 100 * n)
    at, score = shard.best(np.array([0, 1]), np.array([9000, 1]), 2, 1)
    assert at.tolist() == [5, 9] and len(set(score.tolist())) == 1
    assert not len(shard.best(np.array([0, 1]), np.array([9000, 1]), 2, int(score[0]) + 1)[0])


@pytest.mark.parametrize(("dims", "k"), [(6, 32), (64, 32), (150, 10), (300, 32)])
def test_lobpcg_matches_dense(dims, k):
    rng = np.random.default_rng(dims)
    q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    a = q * (1000 * 0.93 ** np.arange(dims)) @ q.T
    blocks = []

    def product(block):
        blocks.append(block.shape[1])
        return a @ block

    values, vectors, residuals = whitening.lobpcg(product, dims, k)
    true, of = np.linalg.eigh(a)
    true, of = true[::-1][:k], of[:, ::-1][:, :k]
    assert np.allclose(values, true, rtol=1e-10) and residuals.max() < 1e-8
    assert (1 - np.abs((vectors * of).sum(0))).max() < 1e-9
    assert max(blocks) <= min(dims, 3 * (k + whitening.GUARD))


def test_whitening_matches_dense(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 40)) @ rng.standard_normal((40, 40)) * 0.1
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(7), 12).toPandas()
    ints = np.floor(64 * x.astype(np.float32).astype(float)).astype(np.int64) + 1_000_000
    c = (500 * ints - ints.sum(0)) / 500
    e, u = np.linalg.eigh(c.T @ c / 500)
    e, u = e[::-1], u[:, ::-1]
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = c @ u[:, :12] / np.sqrt(e[:12])
    want *= np.sign((want * z).sum(0))
    assert np.abs(z - want).max() < 1e-8 and got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, e[:12] / e.sum(), rtol=1e-10)
    one = got.drop_duplicates("vec_id").sort_values("vec_id")
    assert one.deviation.tolist() == [int((d.astype(object) ** 2).sum()) for d in 500 * ints - ints.sum(0)]
