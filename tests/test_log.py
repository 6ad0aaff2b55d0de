"""The log source: order, admission, failures and rewinding."""

import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veldt.sources import log


def folder():
    return f"/tmp/checkpoints/veldt-log-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def written(spark):
    r = random.Random(1)
    rows = [(k, r.randrange(6), None if k % 50 == 0 else f"v{k}") for k in range(1000)]
    home = folder()
    df = spark.createDataFrame(rows, "at long, key long, v string")
    old = log.SEGMENT
    log.SEGMENT = 70
    try:
        log.append(df.where("at < 600").repartition(5), home, F.col("key") % 3, ["at"], 3)
        log.append(df.where("at >= 600").repartition(5), home, F.col("key") % 3, ["at"], 3)
    finally:
        log.SEGMENT = old
    want = defaultdict(list)
    for at, key, v in rows:
        want[key % 3].append((at, key, v))
    return home, df.schema, want


def read(spark, written, checkpoint, fail_at=None, **more):
    """Rows by partition of batches, as they lie under their numbers."""
    home, schema, _ = written

    def emit(batch, number):
        if number == fail_at:
            batch.limit(3).write.mode("overwrite").parquet(f"{checkpoint}/out/batch={number}")
            raise RuntimeError("half done")
        batch.write.mode("overwrite").parquet(f"{checkpoint}/out/batch={number}")

    log.consume(log.read_stream(spark, home, schema, checkpoint, **more), checkpoint, emit)
    return spark.read.parquet(f"{checkpoint}/out")


def by_part(df):
    out = defaultdict(list)
    for x in df.orderBy("log_part", "log_offset").collect():
        out[x["log_part"]].append((x["log_offset"], (x["at"], x["key"], x["v"])))
    return out


def test_all_rows_in_order(spark, written):
    want = written[2]
    assert log.ends(written[0]) == {str(k): len(v) for k, v in want.items()}
    found = read(spark, written, folder(), admit=100)
    assert by_part(found) == {k: list(enumerate(v)) for k, v in want.items()}
    sizes = found.groupBy("batch", "log_part").count().collect()
    assert max(x["count"] for x in sizes) == 100 and len({x["batch"] for x in sizes}) == -(-max(map(len, want.values())) // 100)


def test_a_failed_batch_resumes_at_the_gap(spark, written):
    checkpoint = folder()
    with pytest.raises(Exception, match="half done"):
        read(spark, written, checkpoint, fail_at=2, admit=60)
    for _ in range(2):  # the second run finds nothing more
        found = read(spark, written, checkpoint, admit=60)
        assert by_part(found) == {k: list(enumerate(v)) for k, v in written[2].items()}


def test_rewinding(spark, written):
    home, _, want = written
    start = log.rewind(home, "at", 700)
    assert start == {str(k): sum(x[0] < 700 for x in v) for k, v in want.items()}
    found = read(spark, written, folder(), start=start)
    assert by_part(found) == {k: [(n, x) for n, x in enumerate(v) if x[0] >= 700] for k, v in want.items()}
    assert log.rewind(home, "at", 5000) == log.ends(home)


def test_growing_and_empty_logs(spark, written):
    home, checkpoint, schema = folder(), folder(), written[1]
    assert log.ends(home) == {}
    df = spark.createDataFrame([(1, 1, "a"), (2, None, "b")], schema)
    log.append(df, home, F.col("key") % 3, ["at"], 3)
    grown = (home, schema, None)
    assert by_part(read(spark, grown, checkpoint)) == {0: [(0, (2, None, "b"))], 1: [(0, (1, 1, "a"))]}
    log.append(df, home, F.col("key") % 3, ["at"], 3)
    assert {k: len(v) for k, v in by_part(read(spark, grown, checkpoint)).items()} == {0: 2, 1: 2}
    log.append(df.limit(0), home, F.col("key") % 3, ["at"], 3)
    assert log.ends(home) == {"0": 2, "1": 2}
