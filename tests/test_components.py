"""Connected components with hubs: no task gets a hub's rows."""

import random

from tests.test_operators import plain_components
from veldt.operators import preparation


def test_against_union_find_with_hot_hubs(spark, monkeypatch):
    monkeypatch.setattr(preparation, "HOT_ROWS", 20)
    r = random.Random(4)
    edges = [(0, k) for k in range(1, 300)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(k, k + 1) for k in range(2000, 2200)] + [(5, 5), (7, None)]
    df = spark.createDataFrame(edges, "x long, y long").repartition(6)
    found = {n["node"]: n["component"] for n in preparation.components(df, "x", "y").collect()}
    assert found == plain_components([e for e in edges if None not in e and e[0] != e[1]])
    assert preparation.components(df.limit(0), "x", "y").count() == 0


def test_rows_of_a_hot_key_are_not_shuffled(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(preparation, "HOT_ROWS", 1000)
    left = spark.range(20_000).selectExpr("IF(id % 10 < 9, 1, id) AS k", "id")
    right = left.groupBy("k").count().withColumnRenamed("count", "met").selectExpr("k", "met", "k * 2 AS twice")
    right.write.parquet(f"{tmp_path}/right")
    right = spark.read.parquet(f"{tmp_path}/right")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = preparation.spread_join(left, right, "k", "met")
        assert out.count() == 20_000 and out.where("twice <> k * 2").count() == 0
        plan = out._jdf.queryExecution().executedPlan().toString()
        # the rows of the hot key come from a join that moves nothing of the left
        assert plan.count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
