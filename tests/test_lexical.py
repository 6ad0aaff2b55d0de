"""Lexical search in blocks against plain counts."""

import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from veldt.operators import lexical


def plain(docs, queries):
    """{query: [(key, hits), ...]} by hits, then key, nulls first."""
    words, asked = {}, {}
    for k, t in docs:
        words.setdefault(k, Counter()).update(re.findall("[a-z0-9]+", (t or "").lower()))
    for q, t in queries:
        asked.setdefault(q, set()).update(re.findall("[a-z0-9]+", (t or "").lower()))
    hits = {q: [(k, sum(n for w, n in c.items() if w in ws)) for k, c in words.items()] for q, ws in asked.items()}
    return {q: sorted((x for x in found if x[1]), key=lambda x: (-x[1], x[0] is not None, x[0])) for q, found in hits.items()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_give_the_plain_ranks_and_let_out_k_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(lexical, "PACK_ROWS", 256)
    monkeypatch.setattr(lexical, "PACK_WORDS", 1000)
    r = random.Random(3)
    words = [f"w{int(r.expovariate(0.05))}" for _ in range(4000)]
    key = (lambda k: None if k is None else f"d{k}") if kind == "string" else lambda k: k
    docs = [(key(k), " ".join(r.choices(words, k=r.randrange(60)))) for k in [*range(300), 7, 7, None, None]] + [(key(900), None), (key(901), "W1 w1-w1"), (key(902), "é")]
    queries = [(k, " ".join(r.choices(words, k=r.randrange(1, 40)))) for k in [*range(90), 5]] + [(100, None), (101, ""), (102, "w1"), (103, "nowhere")]
    search = lexical.LexicalSearch(spark.createDataFrame(docs, f"k {kind}, t string").repartition(5), spark.createDataFrame(queries, "q long, t string"), "k", "q", "t", "t")
    want = plain(docs, queries)
    packs = search.docs.count()
    assert packs > 3
    assert sorted(map(tuple, search.topk(4).collect()), key=str) == sorted(((q, k, n, i + 1) for q, found in want.items() for i, (k, n) in enumerate(found[:4])), key=str)
    # pairs of queries and documents stay in their task: what leaves it are k rows a query
    out = search._met(lambda block, _: lexical._best(block, 4), "hits").count()
    assert out <= 4 * packs * len(want) < sum(map(len, want.values()))
    picked = [(q, k) for q in (3, 5, 102, 103) for k in (key(7), key(8), key(200), key(901), key(5000))]
    found = search.ranks(spark.createDataFrame([*picked, picked[0], (None, key(1)), (3, None)], f"q long, k {kind}"))
    ranks = {(q, k): (n, i + 1) for q, pairs in want.items() for i, (k, n) in enumerate(pairs)}
    assert {(x["q"], x["k"]): (x["hits"], x["rank"]) for x in found.collect()} == {p: ranks[p] for p in picked if p in ranks}


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "k long, t string")
    none = spark.createDataFrame([], "k long, t string")
    for left, right in ((docs, none), (none, docs), (none, none)):
        search = lexical.LexicalSearch(left, right.withColumnRenamed("k", "q"), "k", "q", "t", "t")
        assert search.topk(3).collect() == [] == search.ranks(docs.withColumnRenamed("t", "x").withColumn("q", docs.k).select("q", "k")).collect()


def test_tasks_bring_packs_together_and_read_few_at_once(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PACK_WORDS", 100_000)
    monkeypatch.setitem(lexical.LARGE_ROWS, "parquet.block.size", str(1 << 20))
    r = random.Random(5)
    docs = [(k, " ".join(f"w{r.randrange(60_000)}" for _ in range(500))) for k in range(3000)]
    queries = [(k, " ".join(f"w{r.randrange(60_000)}" for _ in range(40))) for k in range(40)]
    search = lexical.LexicalSearch(spark.createDataFrame(docs, "k long, t string").coalesce(1), spark.createDataFrame(queries, "q long, t string").repartition(8), "k", "q", "t", "t")
    packs, files = search.docs.count(), search.docs.inputFiles()
    assert packs > 10 and len(files) == 1
    # a reader decodes a row group at once
    groups = pq.ParquetFile(files[0].removeprefix("file:")).metadata
    assert groups.num_row_groups > 3
    # a query's best rows leave a task once, not once a pack, and small query files don't make packs of their own
    out = search._met(lambda block, _: lexical._best(block, 4), "hits", fewer=lambda found: lexical._first(found, 4))
    assert out.count() <= 4 * len(queries) * min(search.docs.rdd.getNumPartitions(), lexical.TASKS) < 4 * len(queries) * packs
    want = plain(docs, queries)
    top = sorted((q, k, n, i + 1) for q, found in want.items() for i, (k, n) in enumerate(found[:4]))
    assert sorted(map(tuple, search.topk(4).collect())) == top
    picked = [(q, k) for q in (3, 5) for k in range(0, 3000, 7)]
    ranks = {(q, k): (n, i + 1) for q, pairs in want.items() for i, (k, n) in enumerate(pairs)}
    asked = spark.createDataFrame(picked, "q long, k long")
    assert {(x["q"], x["k"]): (x["hits"], x["rank"]) for x in search.ranks(asked).collect()} == {p: ranks[p] for p in picked if p in ranks}
    # more than a task may hold goes out early
    monkeypatch.setattr(lexical, "HELD_ROWS", 50)
    assert sorted(map(tuple, search.topk(4).collect())) == top
    assert {(x["q"], x["k"]): (x["hits"], x["rank"]) for x in search.ranks(asked).collect()} == {p: ranks[p] for p in picked if p in ranks}
