"""A sink for several tables at once: tasks write files and report them, the driver makes them visible with one manifest.

``home/data/TABLE`` holds files that nobody sees by themselves; ``home/manifests`` says which of them are committed. A manifest appears whole,
so a reader sees all tables of a transaction or none. A transaction has a name (a stream's is its batch's number): if it is
committed already, committing it again changes nothing. One driver writes to a home at a time. The folder is as in ``veldt.sources.log``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from veldt.sources.log import get, opened, put


@dataclass
class Written(WriterCommitMessage):
    """(table, path, rows) of the files of a task."""

    files: list[tuple[str, str, int]]


def together(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of all: a column for each table that holds its rows as structs and is null in rows of the others."""
    out = None
    for name, df in tables.items():
        own = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def write_files(home: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """The rows of a task, one file for each table it has rows of."""
    found: dict[str, tuple[str, pq.ParquetWriter, list[int]]] = {}
    for batch in batches:
        for name, column in zip(batch.schema.names, batch.columns):
            own = column.drop_null()
            if len(own):
                rows = pa.RecordBatch.from_struct_array(own)
                if name not in found:
                    fs, p = opened(f"{home}/data/{name}")
                    fs.create_dir(p, recursive=True)
                    path = f"{p}/{uuid.uuid4().hex}.parquet"
                    found[name] = path, pq.ParquetWriter(path, rows.schema, filesystem=fs, compression="zstd"), [0]
                found[name][1].write_batch(rows)
                found[name][2][0] += rows.num_rows
    for _, writer, _ in found.values():
        writer.close()
    return Written([(name, path, n[0]) for name, (path, _, n) in found.items()])


def publish(home: str, name: str, messages: list) -> bool:
    """Make the files of a transaction visible; False, and no file stays, if it was committed before."""
    files = [f for m in messages if m is not None for f in m.files]
    if get(f"{home}/manifests/{name}.json") is not None:
        discard(home, messages)
        return False
    put(f"{home}/manifests/{name}.json", json.dumps(files).encode())
    return True


def discard(home: str, messages: list) -> None:
    fs, _ = opened(home)
    for _, path, _ in [f for m in messages if m is not None for f in m.files]:
        fs.delete_file(path)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, home: str, name: str):
        self.home, self.name = home, name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_files(self.home, iterator)

    def commit(self, messages: list) -> None:
        publish(self.home, self.name, messages)

    def abort(self, messages: list) -> None:
        discard(self.home, messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, home: str, stream: str):
        self.home, self.stream = home, stream

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_files(self.home, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        publish(self.home, f"{self.stream}-{batchId:012d}", messages)

    def abort(self, messages: list, batchId: int) -> None:
        discard(self.home, messages)


class CommitSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "veldt_commit"

    def writer(self, schema: T.StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["home"], self.options["transaction"])

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["home"], self.options["stream"])


def save(tables: dict[str, DataFrame], home: str, transaction: str) -> None:
    """Write several tables as one transaction. If a task fails for good, nothing of it is seen."""
    df = together(tables)
    df.sparkSession.dataSource.register(CommitSink)
    df.write.format("veldt_commit").options(home=home, transaction=transaction).mode("append").save()


def save_stream(tables: dict[str, DataFrame], home: str, stream: str, checkpoint: str) -> None:
    """Each batch of the streams is a transaction, until what is there now is done."""
    df = together(tables)
    df.sparkSession.dataSource.register(CommitSink)
    df.writeStream.format("veldt_commit").options(home=home, stream=stream, checkpointLocation=checkpoint).trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, home: str, table: str, schema: str | T.StructType) -> DataFrame:
    """The committed rows of a table."""
    fs, p = opened(f"{home}/manifests")
    paths = []
    for info in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)):
        if info.path.endswith(".json"):
            paths += [path for name, path, _ in json.loads(get(info.path) or b"[]") if name == table]
    # paths of another file system than the session's own need its address in front
    front = home.split("://")[0] + "://" if "://" in home else "file://" if home.startswith(("/", "file:")) else ""
    return spark.read.schema(schema).parquet(*[front + x for x in paths]) if paths else spark.createDataFrame([], schema)
