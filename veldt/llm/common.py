"""What the operators of this folder share: shared scratch tables, row keys and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the cluster names no shared folder, as in tests on one machine.
LOCAL_SCRATCH = "/tmp/checkpoints"


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir), which driver and executors all see."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors see")
        folder = LOCAL_SCRATCH
    return folder.rstrip("/")


class Tables:
    """Tables dealt by a column into the same number of buckets, so that joins on it don't shuffle them; dropped at the end."""

    def __init__(self, spark: SparkSession, by: str = "key"):
        self.spark, self.by, self.names = spark, by, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Each task of ``df`` is best to hold few buckets, as it writes a file for each."""
        table = f"veldt_{name}_{uuid.uuid4().hex}"
        self.names.append(table)
        df.write.option("path", f"{scratch(self.spark)}/{table}").option("compression", "zstd").bucketBy(self.buckets, self.by).saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            forget(self.spark, f"{scratch(self.spark)}/{name}")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of the map of keys in ``doubtful``: at least 1 MB and at most 32 MB, in pages of 4 KB.
MAP_BITS, MOST_MAP_BITS, PAGE_BITS = 1 << 23, 1 << 28, 1 << 15


def doubtful(docs: DataFrame, keys: DataFrame, key: str, name: str = "__doubtful") -> DataFrame:
    """``docs`` with a boolean added: false where ``key`` surely isn't in the one column of ``keys``, true for all others.

    A bit map of hashed keys is broadcast, which has about sixteen bits a key within fixed bounds. It takes no shuffle of
    ``docs``; what is to be told apart exactly is the rows found doubtful only. However full the map is, no key of ``keys`` is
    missed. ``keys`` is to be a written table, as it is read twice.
    """
    bits = min(max(MAP_BITS, 1 << (16 * keys.count()).bit_length()), MOST_MAP_BITS)
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    pages = keys.select(spot(F.col(keys.columns[0])).alias("at")).groupBy(F.expr(f"at div {PAGE_BITS}").alias("__page"))
    pages = stored(pages.agg(F.bitmap_construct_agg(F.col("at") % PAGE_BITS).alias("__bits")), "map")
    columns = [f"`{c}`" for c in docs.columns]
    placed = docs.select(*columns, spot(F.col(key)).alias("__at")).join(F.broadcast(pages), F.expr(f"__at div {PAGE_BITS} = __page"), "left")
    byte = F.conv(F.hex(F.substring("__bits", F.expr(f"cast(__at % {PAGE_BITS} div 8 as int) + 1"), F.lit(1))), 16, 10).cast("long")
    set_ = F.call_function("shiftright", byte, F.expr("cast(__at % 8 as int)")).bitwiseAND(F.lit(1)) == 1
    return placed.select(*columns, F.coalesce(set_, F.lit(False)).alias(name))


def without(docs: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` stands in the one column of ``lost``; rows with a null key stay.

    Only rows found doubtful, the lost ones and a few more, are shuffled with their texts to be told apart exactly.
    """
    columns = [f"`{c}`" for c in docs.columns]
    placed = doubtful(docs, lost, key)
    told = placed.where("__doubtful").join(lost, F.col(key) == F.col(lost.columns[0]), "left_anti")
    return placed.where("NOT __doubtful").select(*columns).unionByName(told.select(*columns))


#: A key is hot if more than one in so many rows have it; so there are fewer hot keys than that. Its rows are dealt to so many parts.
HOT_SHARE, HOT_PARTS = 4096, 64


def spread_join(left: DataFrame, right: DataFrame, on: str, met: str, total: int, by: Column, how: str) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``on`` and in ``met`` how many of ``total`` rows of the left have it.

    The rows of hot keys are dealt by ``by`` to HOT_PARTS parts and meet a copy of the key's row in each. The list of hot keys is
    broadcast; it is shorter than HOT_SHARE, as their rows add up to ``total``. A written ``right`` is read twice, not computed.
    """
    hot = right.where(F.col(met) * HOT_SHARE > total).select(F.col(on).alias("__hot"))
    parts = lambda is_hot: F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    many = right.withColumn("__part", F.explode(parts(F.col(met) * HOT_SHARE > total)))
    dealt = left.join(F.broadcast(hot), F.col(on) == F.col("__hot"), "left")
    part = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0))
    return dealt.withColumn("__part", part).drop("__hot").join(many, [on, "__part"], how).drop("__part")


def text_once(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """(the columns ``keep`` of ``docs``, position of ``text`` as a string): it is added behind them only if it isn't one of them."""
    columns = [f"`{c}`" for c in keep]
    if text in keep and docs.schema[text].dataType.typeName() == "string":
        return docs.select(*columns), keep.index(text)
    return docs.select(*columns, F.col(text).cast("string").alias("__text")), len(keep)


def slices(batches: Iterator[pa.RecordBatch], at: int, rows: int = 512, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of text in column ``at``; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            most = (ends[first - 1] if first else 0) + size
            last = min(first + rows, max(first + 1, int(np.searchsorted(ends, most, side="right"))), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    The lineage ends at the files, so a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/veldt-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an edge list of longs: rows (node, component), component the smallest node.

    Randomised contraction: in every round each node joins the neighbour (or itself) that comes first in that
    round's random order, and edges are rewritten between the chosen nodes. The number of edges shrinks by a
    constant factor in expectation whatever the shape of the graph, and a round needs only a partial
    aggregation and equi-joins, so a hub with many neighbours is combined before the shuffle.
    Nodes without edges are not returned. Null ends are ignored.
    """
    e = stored(
        edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .where("a < b")
        .distinct(),
        "edges",
    )
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        order = F.lit(len(rounds))
        both = e.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(
            e.select(F.col("b").alias("node"), F.col("a").alias("next"))
        )
        first = both.groupBy("node").agg(F.min(F.struct(F.xxhash64(order, "next").alias("h"), "next")).alias("m"))
        own = F.struct(F.xxhash64(order, "node").alias("h"), F.col("node").alias("next"))
        chosen = stored(first.select("node", F.least(own, "m")["next"].alias("rep")), "chosen")
        e = stored(
            e.join(chosen.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a")
            .join(chosen.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
        rounds.append(chosen)
    if not rounds:
        return e.select(F.col("a").alias("node"), F.col("a").alias("component"))
    labels = rounds[-1]
    for chosen in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("rep"), F.col("rep").alias("later"))
        labels = chosen.join(later, "rep", "left").select("node", F.coalesce("later", "rep").alias("rep"))
    labels = stored(labels, "labels")
    least = labels.groupBy("rep").agg(F.min("node").alias("component"))
    return labels.join(least, "rep").select("node", "component")
