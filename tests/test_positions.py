"""The positional index against plain lists of words."""

import random
import re
import uuid

import duckdb
import pytest

from veldt.functions import stems
from veldt.operators import positions
from veldt.plans import catalog

DIR = "/root/testdata/sf0.001"


def covers(words, asked):
    """Minimal stretches that hold all asked words, by trying every one."""
    found = []
    for a in range(len(words)):
        b = next((b for b in range(a, len(words)) if asked <= set(words[a : b + 1])), None)
        if b is not None and not asked <= set(words[a + 1 : b + 1]):
            found.append((a, b))
    return [(a, b, sum(w not in asked for w in words[a : b + 1])) for a, b in found]


def plain(docs, queries):
    out = []
    for q, text in queries:
        asked = set(re.findall("[a-z0-9]+", (text or "").lower()))
        scores = {}
        for key, words in docs.items():
            found = covers(words, asked) if asked else []
            if found:
                scores[key] = round(sum(0.1 / (1 + strange) for _, _, strange in found), 9)
        out += [(q, k, scores[k], i + 1) for i, k in enumerate(sorted(scores, key=lambda k: (-scores[k], k)))]
    return sorted(out)


@pytest.fixture()
def index(spark, tmp_path):
    made = []

    def build(docs, **more):
        name = f"postings_{uuid.uuid4().hex}"
        made.append((name, f"{tmp_path}/{name}"))
        return positions.write_postings(docs, "k", "t", name, f"{tmp_path}/{name}", 4, **more)

    yield build
    for name, path in made:
        positions.drop_postings(spark, name, path)


def test_covers_are_the_plain_ones(spark, index):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randrange(40))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "A-a, B\nb c"), (None, "a b c"), (103, "x " * 30_000 + "a b " + "x " * 30_000 + "c")]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "k long, t string, term string")
    found = index(docs, parts=5)
    asked = [(1, "a b c"), (2, "a A a"), (3, "nowhere a"), (4, None), (5, ""), (6, "g f e d c b a"), (7, "b a")]
    queries = spark.createDataFrame([*asked, (7, "b a"), (None, "a")], "q long, t string")
    words = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in rows if k is not None and t}
    got = sorted(map(tuple, positions.ranked_by_cover(found, queries, "q", "t", "k", 5).collect()))
    short = {k: w for k, w in words.items() if k != 103}
    assert [x for x in got if x[1] != 103 and x[0] in (1, 2, 3, 6, 7)] == [x for x in got if x[1] != 103]
    assert sorted((q, k, s) for q, k, s, _ in got if k != 103) == sorted((q, k, s) for q, k, s, _ in plain(short, asked))
    assert [s for q, k, s, _ in got if k == 103 and q == 1] == [round(0.1 / 30_001, 9)]
    hits = {(x["q"], x["k"]): x["hits"] for x in positions.ranked_by_hits(found, queries, "q", "t", "k", 5).collect()}
    want = {(q, k): sum(w in set((t or "").lower().split()) for w in ws) for q, t in asked for k, ws in words.items()}
    assert hits == {k: n for k, n in want.items() if n}
    empty = index(docs.limit(0))
    assert positions.ranked_by_cover(empty, queries, "q", "t", "k").count() == 0 == positions.ranked_by_cover(found, queries.limit(0), "q", "t", "k", 5).count()


def test_stems_and_a_word_of_all_documents(spark, index):
    docs = spark.range(3000).selectExpr("id AS k", "concat('running dogs ', id % 7) AS t")
    found = index(docs, analyse=stems.analysed)
    assert found.where("term = 'dog'").groupBy("part").count().selectExpr("max(count)").first()[0] < 3000 / 20
    queries = spark.createDataFrame([(1, "the dog runs")], "q long, t string")
    got = positions.ranked_by_cover(found, queries, "q", "t", "k", analyse=stems.analysed)
    assert got.count() == 3000 and {x[0] for x in got.select("score").distinct().collect()} == {0.1}


def test_query_is_its_twin(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = catalog.queries()["position_ranks"](spark, DIR)
    assert sorted(map(tuple, got.select("kind", "query_id", "doc_id", "score", "rank").collect())) == sorted(con.sql(catalog.oracle_sql()["position_ranks"]).fetchall())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ranks_of_parts_are_the_plain_ones_and_pairs_stay_in_their_task(spark, index, monkeypatch, kind):
    monkeypatch.setattr(positions, "QUERIES", 3)
    r = random.Random(8)
    key = (lambda k: f"d{k}") if kind == "string" else lambda k: k
    rows = [(key(k), " ".join(r.choice("abcdef") for _ in range(r.randrange(6)))) for k in [*range(400), 7, 7]]
    found = index(spark.createDataFrame(rows, f"k {kind}, t string").repartition(3), parts=9)
    assert found.select("part").distinct().count() == 9
    asked = [(q, " ".join(r.sample("abcdefz", 3))) for q in range(10)]
    ranked = positions.ranked_by_hits(found, spark.createDataFrame(asked, "q long, t string"), "q", "t", "k", 9)
    totals = {}
    for k, t in rows:
        for q, ws in asked:
            n = sum(w in ws.split() for w in t.split())
            totals[q, k] = totals.get((q, k), 0) + n
    want = []
    for q, _ in asked:
        own = sorted(((k, n) for (x, k), n in totals.items() if x == q and n), key=lambda x: (-x[1], x[0]))
        want += [(q, k, n, round(0.1 * n, 9), i + 1) for i, (k, n) in enumerate(own)]
    assert sorted(map(tuple, ranked.collect())) == sorted(want)
    # nothing is exchanged behind the ranks: a row for each pair goes straight to who asked
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    # ranges of keys follow one another
    ends = found.groupBy("part").agg({"key": "max"}).join(found.groupBy("part").agg({"key": "min"}), "part").orderBy("part").collect()
    assert all(a["max(key)"] < b["min(key)"] for a, b in zip(ends, ends[1:]))
