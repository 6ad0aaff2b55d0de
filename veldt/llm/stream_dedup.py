"""Exact dedup as a stateful stream.

Documents arrive as a file stream. A streaming aggregation keyed by content digest keeps, in a RocksDB state store on disk and
without expiry: the digest, the stable identifier of the row that stays and the locator of its content (file and
identifier), and how many rows were met. Copies combine in each task before they reach the state, so a text that makes up a
third of all rows costs one state row and a few shuffled ones. Each micro-batch emits the state rows it changed.

Equal digests are a hit, not yet a copy: the full bytes of all hits are compared, the located content among them. A fixed-size
map of the digests that were hit tells, without a shuffle, which rows may be hits; of these each task sends a text once, and a digest
left with two different texts is divided by text. Rows that are no hits never leave their task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import doubtful, scratch, spread_join, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How the state is kept: in RocksDB, which is not to set 4 MB of disk aside for each of many small stores.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILES_PER_BATCH = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def keyed_state(docs: DataFrame) -> DataFrame:
    """The streaming aggregation: ``docs`` has (key, digest, file); state rows (digest, kept, seen) come out on change.

    kept is a struct (key, file): the largest key met so far and the file that holds its content.
    """
    return docs.groupBy("digest").agg(F.max(F.struct("key", "file")).alias("kept"), F.count(F.lit(1)).alias("seen"))


def groups_of_stream(
    spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", files_per_batch: int = FILES_PER_BATCH, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Run the stream over the files now under ``path``; rows (digest, kept, seen): the last state of each digest.

    The stream's checkpoint and its emitted rows lie in the shared folder; a failed batch is run again from there and
    writes the same folder, so nothing counts twice.
    """
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    one = f"{path[:-1]}[{path[-1]}]"  # a pattern that matches the path alone: a stream takes a single file only so
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(one)
        .select(F.col(key).alias("key"), digest(normalised(text)).alias("digest"), F.col("_metadata.file_path").alias("file"))
    )
    state = keyed_state(stream)
    home = f"{scratch(spark)}/veldt-stream-{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], state.schema)
    empty.write.parquet(f"{home}/rows/batch=-1")

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").foreachBatch(emit).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    rows = spark.read.schema(state.schema).parquet(f"{home}/rows")
    # the state only grows: of a digest's emitted rows the one with the largest count is the last
    return rows.groupBy("digest").agg(F.max_by("kept", "seen").alias("kept"), F.max("seen").alias("seen"))


def deduplicate(
    spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", files_per_batch: int = FILES_PER_BATCH, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row under ``path``: (key, keep_id, group_size, kept, text_sha256, keep_file).

    Texts are equal when identical after A-Z became lower case; null counts as empty. Of equal texts the row with the largest
    key stays; rows that repeat that key and text all count as kept. A null key stays only where the group has no other
    (keep_id is then null). keep_file is the content locator of the row that stays. Other columns are not read. An empty table
    gives no rows.
    """
    state = stored(groups_of_stream(spark, path, key, text, files_per_batch, digest), "groups")
    total = state.agg(F.sum("seen")).first()[0] or 0
    hits = stored(state.where("seen > 1").select("digest", F.col("kept.key").alias("keep_id"), F.col("kept.file").alias("keep_file"), "seen"), "hits")
    docs = spark.read.parquet(path)
    rows = docs.select(F.col(key).alias("key"), F.col("_metadata.file_path").alias("file"), normalised(text).alias("body")).withColumn("digest", digest(F.col("body")))
    sha = F.col("digest") if digest is sha256 else sha256(F.col("body"))
    rows = doubtful(rows, hits.select("digest"), "digest", "hit").withColumn("text_sha256", sha)
    told = stored(rows.select("key", "file", "digest", "text_sha256", "hit"), "told")
    # the full bytes: a task's copies become one before the shuffle
    bodies = rows.where("hit").select("digest", "body").distinct()
    collided = stored(bodies.groupBy("digest").count().where("count > 1").select("digest"), "collided")
    names = ["key", "keep_id", "seen", "text_sha256", "keep_file"]
    mine = [F.col("key"), F.coalesce("keep_id", F.when(F.col("seen").isNull(), F.col("key"))).alias("keep_id"), F.coalesce("seen", F.lit(1).cast("long")).alias("seen"), F.col("text_sha256"), F.coalesce("keep_file", "file").alias("keep_file")]
    alone = told.where("NOT hit").select("key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("seen"), "text_sha256", F.col("file").alias("keep_file"))
    joined = spread_join(told.where("hit"), hits, "digest", "seen", total, F.struct("key", "file"), "left")
    if collided.isEmpty():
        judged = joined.select(*mine).unionByName(alone)
    else:
        mixed = rows.where("hit").join(collided, "digest", "left_semi")
        own = mixed.groupBy("digest", "body").agg(F.max(F.struct("key", "file")).alias("kept"), F.count(F.lit(1)).alias("seen"))
        own = own.select("digest", "body", F.col("kept.key").alias("keep_id"), "seen", F.col("kept.file").alias("keep_file"))
        more = mixed.select("key", "digest", "body", "text_sha256").join(own, ["digest", "body"])
        judged = joined.join(collided, "digest", "left_anti").select(*mine).unionByName(alone).unionByName(more.select(names))
    return judged.select(
        F.col("key").alias(key), "keep_id", F.col("seen").alias("group_size"), F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "keep_file"
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark, f"{sf_dir}/documents.parquet").drop("keep_file")
