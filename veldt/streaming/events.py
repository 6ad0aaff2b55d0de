"""Event streams: every operator here has a batch twin in ``veldt.operators.events`` or ``timeseries`` with the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veldt.operators.shared import scratch

#: State lives in RocksDB, which is not to set disk aside for each of many small stores.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def file_stream(spark: SparkSession, path: str, schema: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; ``files_per_batch`` is the back-pressure."""
    found = spark.read.parquet(path).schema if schema is None else schema
    return spark.readStream.schema(found).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_end(stream: DataFrame, mode: str, emit: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is there now; the emitted rows, each with its ``batch``.

    Rows go to files under the batch's number, so a batch that runs again after a failure replaces its own. With the
    same ``checkpoint`` a later call takes up where the last one ended.
    """
    spark = stream.sparkSession
    home = checkpoint or f"{scratch(spark)}/veldt-stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{home}/rows/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        if emit is not None:
            emit(batch, number)
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    return spark.read.option("basePath", f"{home}/rows").parquet(f"{home}/rows")


def first_of(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key that arrives; keys are kept without expiry."""
    return stream.dropDuplicates(keys)


def first_within(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed it by ``delay``."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def highest(stream: DataFrame, key: str, revision: str) -> DataFrame:
    """Running (key, revision, n): the highest revision of each key, sent out whenever it changes (update mode)."""
    return stream.groupBy(key).agg(F.max(revision).alias(revision), F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, at: str, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts of tumbling windows; a window is sent out once the watermark has passed it (append mode)."""
    w = F.window(F.col(at), width)
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return marked.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def furthest_state(stream: DataFrame, key: str, state: str, ranks: dict[str, int]) -> DataFrame:
    """(key, state) whenever a key reaches a further state than before; keys are longs, states never go back."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        reached = kept.get[0] if kept.exists else -1
        top = max((ranks[s] for p in parts for s in p[state]), default=-1)
        if top > reached:
            kept.update((top,))
            name = next(n for n, r in ranks.items() if r == top)
            yield pd.DataFrame({key: [k[0]], state: [name]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, {state} string", "rank int", "update", GroupStateTimeout.NoTimeout)


def due(messages: DataFrame, at: str, delay_seconds: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(messages that are due at ``now``, those that must wait): a delayed topic read in batches."""
    ready = F.timestamp_seconds(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000 + F.col(delay_seconds)) <= F.lit(now).cast("timestamp")
    return messages.where(ready), messages.where(~ready)
