"""Segmented scans against plain ones, with keys cut into slices and without."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veldt.operators import keyed, scan, timeseries


def series(seed=1, n=400):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "a", "b", None]), at, round(r.random() * 9, 2)) for at in r.sample(range(10_000), n)]
    return rows, defaultdict(list, {k: sorted((at, v) for j, at, v in rows if j == k) for k in {x[0] for x in rows}})


@pytest.mark.parametrize("hot_rows", [None, 50, 7])
def test_increases_and_ranges(spark, hot_rows):
    rows, by = series()
    step, want, ranged = {}, {}, {}
    for k, own in by.items():
        upto = 0.0
        for n, (at, v) in enumerate(own):
            up = 0.0 if n == 0 else v if v < own[n - 1][1] else v - own[n - 1][1]
            upto += up
            step[k, at] = upto
            want[k, at] = round(up, 6)
            ranged[k, at] = round(upto - next(step[k, a] for a, _ in own if a >= at - 700), 6)
    df = spark.createDataFrame(rows, "k string, at long, v double").repartition(3)
    assert {(x["k"], x["at"]): round(x["increase"], 6) for x in timeseries.increases(df, ["k"], "at", "v", hot_rows).collect()} == want
    assert {(x["k"], x["at"]): round(x["increase"], 6) for x in timeseries.range_increases(df, ["k"], "at", "v", 700, hot_rows).collect()} == ranged


@pytest.mark.parametrize("hot_rows", [None, 40, 5])
def test_history(spark, hot_rows):
    r = random.Random(2)
    rows = [(n, r.choice(["hot", "hot", "x", None]), f"2024-{r.randint(1, 3):02d}-{r.randint(1, 28):02d}", r.choice([None, 1, 5, 7])) for n in range(300)]
    want = {}
    for n, k, day, _ in rows:
        own = [v for _, j, d, v in rows if j == k and d < day]
        seen = [v for v in own if v is not None]
        want[n] = (len(own), sum(seen) if seen else None, min(seen, default=None), max(seen, default=None))
    df = spark.createDataFrame(rows, "n int, k string, d string, v int").withColumn("d", F.col("d").cast("date"))
    measures = {"c": ("count", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    found = keyed.history_before(df, "k", "d", measures, hot_rows)
    assert found.columns == ["n", "k", "d", "v", "c", "s", "lo", "hi"]
    assert {x["n"]: (x["c"], x["s"], x["lo"], x["hi"]) for x in found.collect()} == want
    assert keyed.history_before(df.limit(0), "k", "d", measures, hot_rows).count() == 0


def test_a_hot_key_is_spread(spark):
    """No slice of a key with half of all rows holds more than about twice its share."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"), F.col("id").alias("at"))
    rows, split = scan.cut(df, ["k"], "at", 500)
    sizes = [x["count"] for x in rows.groupBy("k", "__slice").count().collect()]
    assert split and max(sizes) <= 1000 and sum(sizes) == 20_000
    assert rows.groupBy("k").agg(F.count_distinct("__slice").alias("n")).where("n > 1").count() == 1
