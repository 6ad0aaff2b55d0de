"""Blocks of vectors meet without a copy of the queries for each block of the corpus."""

import random

import numpy as np

from veldt.operators import retrieval

VECTORS = "id long, v array<double>"


def vectors(n, seed):
    r = random.Random(seed)
    rows = [(k, [float(r.randint(-2, 2)) for _ in range(3 if k % 5 else 4)]) for k in range(n)]
    return [*rows, (n, None), (n + 1, [0.0, 0.0, 0.0]), *[(n + 2 + k, [1.0, 1.0, 0.0]) for k in range(40)]]


def plain(corpus, queries):
    """(query, id, cosine, rank) of all pairs of vectors of one length."""
    out = []
    for q, a in queries:
        found = []
        for c, b in corpus:
            if a and b and len(a) == len(b) and any(a) and any(b):
                found.append((-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9), c))
        out += [(q, c, -s, i + 1) for i, (s, c) in enumerate(sorted(found))]
    return out


def plans(df):
    return df._jdf.queryExecution().toString()


def test_ranks_of_small_blocks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "HELD_ROWS", 50, raising=False)
    rows = vectors(150, 1)
    corpus = spark.createDataFrame(rows, VECTORS)
    queries = corpus.where("id % 10 = 0").selectExpr("id AS q", "v")
    want = plain(rows, [(k, v) for k, v in rows if k % 10 == 0])
    top = retrieval.dense_topk(corpus, queries, "id", "q", "v", 7)
    assert sorted((x["q"], x["id"], x["rank"]) for x in top.collect()) == sorted((q, c, r) for q, c, _, r in want if r <= 7)
    picked = spark.createDataFrame([(q, c) for q in range(0, 200, 10) for c in range(0, 192, 3)], "q long, id long")
    made = []
    pairs = retrieval._block_pairs
    monkeypatch.setattr(retrieval, "_block_pairs", lambda left, right: made.append(pairs(left, right)) or made[-1])
    ranks = retrieval.dense_ranks(corpus, queries, picked, "id", "q", "v")
    assert sorted(map(tuple, ranks.collect())) == sorted((q, c, r) for q, c, _, r in want if c % 3 == 0 and c < 192)
    assert len(made) == 2
    for x in made:
        assert "Broadcast" not in plans(x) and "explode" not in plans(x).lower()


def test_no_rows_and_vectors_without_components(spark):
    corpus = spark.createDataFrame([(1, [0.6, 0.8]), (2, []), (3, []), (4, [float("nan"), 1.0])], VECTORS)
    queries = corpus.selectExpr("id AS q", "v")
    assert [tuple(x) for x in retrieval.dense_topk(corpus, queries, "id", "q", "v", 3).collect()] == [(1, 1, 1.0, 1)]
    picked = spark.createDataFrame([(q, c) for q in range(5) for c in range(5)], "q long, id long")
    assert [tuple(x) for x in retrieval.dense_ranks(corpus, queries, picked, "id", "q", "v").collect()] == [(1, 1, 1)]
    assert retrieval.dense_ranks(corpus.limit(0), queries, picked, "id", "q", "v").count() == 0
    assert retrieval.dense_topk(corpus, queries.limit(0), "id", "q", "v", 3).count() == 0
