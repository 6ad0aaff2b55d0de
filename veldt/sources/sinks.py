"""Sinks: append, evolving CSV, versioned loads that appear whole or not at all, manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_batch(batch: DataFrame, number: int, outputs: dict[str, DataFrame], home: str) -> None:
    """Several outputs of a streaming batch under its number: a batch that is run again replaces its own files."""
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{home}/{name}/batch={number}")


def append_evolving(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Append rows whose columns may be new; read them back with ``read_evolving``."""
    df.write.mode("append").json(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """All rows with the union of their columns; a column that a row lacks is null."""
    return spark.read.json(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def load_version(df: DataFrame, home: str, version: str, checks: dict[str, Callable[[DataFrame], bool]], replace: bool = False) -> str:
    """Write ``df`` as a version under ``home``; it appears by a rename after all checks of the written rows passed.

    An existing version raises unless ``replace`` is set; a frozen one (see ``freeze``) always does.
    """
    spark = df.sparkSession
    target, staged = f"{home}/{version}", f"{home}/_staged-{uuid.uuid4().hex}"
    if exists(spark, f"{target}/_FROZEN"):
        raise ValueError(f"{version} is frozen")
    if exists(spark, target) and not replace:
        raise ValueError(f"{version} exists")
    df.write.parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    fs, staged_path = _fs(spark, staged)
    failed = [name for name, check in checks.items() if not check(rows)]
    if failed:
        fs.delete(staged_path, True)
        raise ValueError(f"{version}: {', '.join(failed)}")
    _, path = _fs(spark, target)
    # an old version goes aside and is deleted once the new one stands, so that a failure between leaves one of them
    aside = None
    if fs.exists(path):
        _, aside = _fs(spark, f"{home}/_old-{version}-{uuid.uuid4().hex}")
        if not fs.rename(path, aside):
            raise OSError(f"{target} can't be replaced")
    if not fs.rename(staged_path, path):
        if aside is not None:
            fs.rename(aside, path)
        raise OSError(f"{target} can't be made")
    if aside is not None:
        fs.delete(aside, True)
    return target


def freeze(spark: SparkSession, home: str, version: str) -> None:
    """From now on the version can't be replaced."""
    fs, p = _fs(spark, f"{home}/{version}/_FROZEN")
    fs.create(p, True).close()


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table_name, n_rows, n_columns), one for each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
