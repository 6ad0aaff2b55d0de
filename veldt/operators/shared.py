"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors see")
    return (folder or "/tmp/checkpoints").rstrip("/")


#: For rows of many megabytes: a reader decodes up to 4,096 rows of a row group at once, so a group is to hold one or two of them.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as files of the shared folder: lineage ends there, and a lost executor costs a re-read."""
    path = f"{scratch(df.sparkSession)}/veldt-{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
