"""Documents that are too short for a query's best rows aren't multiplied with it."""

import random

from veldt.operators import lexical
from tests.test_lexical import plain


def test_short_documents_are_left_out_and_ranks_stay(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PACK_ROWS", 400)
    monkeypatch.setattr(lexical, "LONGEST", 64, raising=False)
    monkeypatch.setattr(lexical, "AT_ONCE", 8)
    r = random.Random(9)
    words = [f"w{int(r.expovariate(0.02))}" for _ in range(4000)]
    # many ties, and lengths from none to a thousand words
    docs = [(k, " ".join(r.choices(words, k=int(1.5 ** r.randrange(18))))) for k in range(2500)] + [(k, "w1 w2") for k in range(5000, 5600)]
    queries = [(k, " ".join(r.choices(words, k=r.choice([1, 2, 5, 60])))) for k in range(40)] + [(99, "w1"), (98, "nowhere")]
    search = lexical.LexicalSearch(spark.createDataFrame(docs, "k long, t string").coalesce(1), spark.createDataFrame(queries, "q long, t string"), "k", "q", "t", "t")
    want = plain(docs, queries)
    for k in (1, 7, 100):
        assert sorted(map(tuple, search.topk(k).collect())) == sorted((q, d, n, i + 1) for q, found in want.items() for i, (d, n) in enumerate(found[:k]))
    assert search.docs.count() > 5
    # what leaves the pairs of packs isn't k rows for each of them
    found = search._met(lambda block, _: lexical._best(block, 7), "hits").count()
    assert found < 7 * search.docs.count() * len(queries) / 2


def test_counts_of_picked_pairs_leave_a_task_once(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PACK_ROWS", 256)
    r = random.Random(2)
    words = [f"w{k}" for k in range(80)]
    docs = [(k, " ".join(r.choices(words, k=20))) for k in range(3000)]
    queries = [(k, " ".join(r.choices(words, k=6))) for k in range(300)]
    search = lexical.LexicalSearch(spark.createDataFrame(docs, "k long, t string").coalesce(1), spark.createDataFrame(queries, "q long, t string").coalesce(1), "k", "q", "t", "t")
    want = {(q, k): (n, i + 1) for q, found in plain(docs, queries).items() for i, (k, n) in enumerate(found)}
    picked = [(q, k) for q in range(300) for k in range(0, 3000, 100)]
    counted, own = [], lexical.LexicalSearch._met
    monkeypatch.setattr(lexical.LexicalSearch, "_met", lambda self, run, result, *a, **b: counted.append(own(self, run, result, *a, **b)) or counted[-1])
    for held in (6_000_000, 1000):
        monkeypatch.setattr(lexical, "HELD_ROWS", held)
        found = search.ranks(spark.createDataFrame(picked, "q long, k long"))
        assert {(x["q"], x["k"]): (x["hits"], x["rank"]) for x in found.collect()} == {p: want[p] for p in picked if p in want}
    # more pairs than a task may bring together so far went out again with each pack of documents
    monkeypatch.setattr(lexical, "HELD_ROWS", 9000)
    tasks = search.docs.rdd.getNumPartitions()
    assert search.docs.count() > 3 * tasks
    search.ranks(spark.createDataFrame(picked, "q long, k long"))
    assert counted[-1].count() <= len(picked) * tasks * 2
