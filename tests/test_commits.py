"""The sink of transactions and the outcomes of answers that race."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from veldt.operators import events as E
from veldt.sources import commits

KEPT = "k long, v string"


def folder():
    return f"/tmp/checkpoints/veldt-commits-{uuid.uuid4().hex}"


def rows(spark, home, table="a"):
    return sorted((x["k"], x["v"]) for x in commits.committed(spark, home, table, KEPT).collect())


def files(home):
    return sum(len(f) for _, _, f in os.walk(f"{home}/data"))


def test_all_tables_or_none(spark):
    home = folder()
    a = spark.createDataFrame([(k, f"v{k}") for k in range(50)], KEPT).repartition(4)
    b = spark.createDataFrame([(k, None) for k in range(3)], KEPT)
    assert rows(spark, home) == []
    commits.save({"a": a, "b": b}, home, "one")
    want = sorted((k, f"v{k}") for k in range(50))
    assert rows(spark, home) == want and rows(spark, home, "b") == [(k, None) for k in range(3)]
    before = files(home)
    commits.save({"a": a, "b": b}, home, "one")  # committed before: nothing changes
    assert rows(spark, home) == want and files(home) == before
    broken = a.withColumn("v", F.when(F.col("k") == 49, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        commits.save({"a": broken, "b": b}, home, "two")
    assert rows(spark, home) == want and rows(spark, home, "b") == [(k, None) for k in range(3)]
    commits.save({"a": a.limit(0), "b": b}, home, "three")
    assert rows(spark, home) == want and len(rows(spark, home, "b")) == 6


def test_batches_of_a_stream(spark):
    home, source = folder(), folder()
    for k in range(3):
        spark.createDataFrame([(10 * k + j, f"v{j}") for j in range(5)], KEPT).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(KEPT).option("maxFilesPerTrigger", 1).parquet(source)
    for checkpoint in (f"{home}/one", f"{home}/one", f"{home}/two"):  # a new checkpoint runs the same batches again
        commits.save_stream({"a": stream(), "b": stream().where("k < 10")}, home, "s", checkpoint)
        assert rows(spark, home) == sorted((10 * k + j, f"v{j}") for k in range(3) for j in range(5)) and len(rows(spark, home, "b")) == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes(spark, seed):
    r = random.Random(seed)
    make = lambda n: [(k, r.choice([None, 1, 2, 3, 4, 5, 6]), r.choice("ab" if r.random() < 0.7 else [None, "c"]), r.choice([None, "x", "y", "z"])) for k in range(n)]
    store, known = {}, []
    for _, key, stable, body in make(6):
        if store.setdefault(key, stable) == stable:
            known.append((key, stable, body))
    held, want, rows_ = set(known), {}, make(80)
    for o, key, stable, body in rows_:
        if store.setdefault(key, stable) != stable:
            want[o] = "conflict"
        else:
            want[o] = "already_answered" if (key, stable, body) in held else "saved"
            held.add((key, stable, body))
    df = spark.createDataFrame(rows_, "o long, k long, s string, b string")
    found = E.save_outcomes(df, spark.createDataFrame(known, "k long, s string, b string"), "k", "s", "b", "o")
    assert {x["o"]: x["outcome"] for x in found.collect()} == want and set(want.values()) == {"saved", "conflict", "already_answered"}
    assert E.save_outcomes(df.limit(0), df.select("k", "s", "b"), "k", "s", "b", "o").count() == 0
