"""A partitioned log in a folder, written in order of offsets and read as a stream with offsets of its own.

``home/part=K/BASE-COUNT.parquet`` holds the rows of offsets BASE to BASE + COUNT - 1 of partition K. Rows of a key lie in one partition in
order. The folder is to be one that driver and executors share and pyarrow can open: a mounted path or an address it knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Rows of a segment file at most, and rows a batch admits from each partition unless told otherwise.
SEGMENT, ADMIT = 100_000, 100_000


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it)."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """The whole file or none: it is written aside and moved to its place."""
    fs, p = opened(path)
    aside = f"{p}.{uuid.uuid4().hex}"
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(aside) as out:
        out.write(data)
    fs.move(aside, p)


def get(path: str) -> bytes | None:
    fs, p = opened(path)
    if fs.get_file_info(p).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(p) as file:
        return file.read()


def segments(home: str) -> dict[int, list[tuple[int, int, str]]]:
    """(base, rows, path) of each partition's segments in order. Of a base that stands twice, as after a failed append, the first name counts."""
    fs, p = opened(home)
    found: dict[int, dict[int, tuple[int, int, str]]] = {}
    for info in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True, recursive=True)):
        folder, _, name = info.path.rpartition("/")
        if name.endswith(".parquet") and "part=" in folder:
            base, count = map(int, name[: -len(".parquet")].split("-"))
            found.setdefault(int(folder.rpartition("=")[2]), {}).setdefault(base, (base, count, info.path))
    out = {}
    for part, by_base in found.items():
        out[part], due = [], 0
        while due in by_base:  # what lies behind a gap isn't part of the log yet
            out[part].append(by_base[due])
            due += by_base[due][1]
    return out


def ends(home: str) -> dict[str, int]:
    """The next offset of each partition; at most one number for each."""
    return {str(k): s[-1][0] + s[-1][1] for k, s in segments(home).items() if s}


def append(df: DataFrame, home: str, part: Column, order: list[str], parts: int) -> None:
    """Rows go to the end of the partitions that ``part`` (0 to ``parts`` - 1) names, each in ``order``; one writer at a time.

    A partition is written as a stream by one task, whatever it holds, as its offsets follow one another. A task that runs again writes
    the same files. Rows of null ``part`` go to partition 0.
    """
    start = ends(home)
    names = df.columns
    rows = df.withColumn("__part", F.coalesce(part.cast("int"), F.lit(0)))
    keys = ["__part", *order]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_now, base, held, size = None, 0, [], 0

        def flush() -> None:
            nonlocal base, held, size
            if size:
                sink = pa.BufferOutputStream()
                pq.write_table(pa.Table.from_batches(held), sink, compression="zstd")
                put(f"{home}/part={part_now}/{base:020d}-{size}.parquet", sink.getvalue().to_pybytes())
            base, held, size = base + size, [], 0

        for batch in batches:
            place = batch.column(len(names))
            for run in pc.run_end_encode(place).values.to_pylist() if batch.num_rows else []:
                at = pc.index(place, run).as_py()
                n = pc.sum(pc.equal(place, run)).as_py()
                own = batch.slice(at, n).select(names)
                if run != part_now:
                    flush()
                    part_now, base = run, start.get(str(run), 0)
                while own.num_rows:
                    take = min(own.num_rows, SEGMENT - size)
                    held.append(own.slice(0, take))
                    size += take
                    own = own.slice(take)
                    if size >= SEGMENT:
                        flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["done"])

    rows.repartition(parts, "__part").sortWithinPartitions(*keys).mapInArrow(write, "done long").agg(F.sum("done")).collect()


def rewind(home: str, at: str, since) -> dict[str, int]:
    """For each partition the first offset whose ``at`` isn't before ``since``, or its end: files are opened only up to that one."""
    found = ends(home)
    for part, files in segments(home).items():
        for base, _, path in files:
            fs, p = opened(path)
            late = pc.greater_equal(pq.read_table(p, columns=[at], filesystem=fs).column(0), pa.scalar(since))
            first = pc.index(late, True).as_py()
            if first >= 0:
                found[str(part)] = base + first
                break
    return found


@dataclass
class Stretch(InputPartition):
    part: int
    start: int
    end: int


class LogReader(DataSourceStreamReader):
    """Offsets are {partition: next offset}. Each batch takes at most ``admit`` rows of a partition, and one task reads each partition's rows in order.

    ``progress`` is a file for one query: what was planned, so that a query that starts again never plans behind it, and what is done. Done is
    the end of the last batch whose effects are complete, so everything before it is, without a gap.
    """

    def __init__(self, options: dict[str, str]):
        self.home, self.progress = options["path"], options["progress"]
        self.admit = int(options.get("admit", ADMIT))
        self.first = json.loads(options.get("start", "{}"))
        kept = json.loads(get(self.progress) or b"{}")
        self.planned, self.done = kept.get("planned"), kept.get("done")

    def initialOffset(self) -> dict:
        self.planned = {k: self.first.get(k, 0) for k in ends(self.home)} or {"0": 0}
        return self.planned

    def latestOffset(self) -> dict:
        """Further than the last answer by what is admitted, up to the log's end."""
        known = self.planned or {}
        self.planned = {k: max(known.get(k, self.first.get(k, 0)), min(end, known.get(k, self.first.get(k, 0)) + self.admit)) for k, end in ends(self.home).items()} or known or {"0": 0}
        return self.planned

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.planned = {k: max(v, (self.planned or {}).get(k, 0)) for k, v in end.items()}
        self._keep()
        return [Stretch(int(k), start.get(k, self.first.get(k, 0)), v) for k, v in end.items() if v > start.get(k, self.first.get(k, 0))]

    def commit(self, end: dict) -> None:
        self.done = end
        self._keep()

    def _keep(self) -> None:
        put(self.progress, json.dumps({"planned": self.planned, "done": self.done}).encode())

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for base, count, path in segments(self.home).get(partition.part, []):
            first, last = max(partition.start, base), min(partition.end, base + count)
            if first < last:
                fs, p = opened(path)
                at = base
                for batch in pq.ParquetFile(p, filesystem=fs).iter_batches(10_000):
                    a, b = max(first, at), min(last, at + batch.num_rows)
                    if a < b:
                        own = batch.slice(a - at, b - a)
                        yield own.append_column("log_part", pa.array([partition.part] * own.num_rows, pa.int32())).append_column("log_offset", pa.array(range(a, b), pa.int64()))
                    at += batch.num_rows


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "veldt_log"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.options["rows"])).add("log_part", T.IntegerType()).add("log_offset", T.LongType())

    def streamReader(self, schema: T.StructType) -> LogReader:
        return LogReader(self.options)


def read_stream(spark: SparkSession, home: str, rows: T.StructType, checkpoint: str, admit: int = ADMIT, start: dict[str, int] | None = None) -> DataFrame:
    """The log as a stream with log_part and log_offset added, from ``start`` (see ``rewind``) or the first offset on.

    ``checkpoint`` is that of the query: the source keeps its progress beside it, and takes up there when the query starts again.
    """
    spark.dataSource.register(LogSource)
    options = {"path": home, "progress": f"{checkpoint}/source-progress.json", "admit": str(admit), "start": json.dumps(start or {}), "rows": rows.json()}
    return spark.readStream.format("veldt_log").options(**options).load()


def consume(stream: DataFrame, checkpoint: str, emit: Callable[[DataFrame, int], None]) -> None:
    """Run ``emit`` on batch after batch until the log's end is reached; a failure stops at its batch, and a later call takes up there."""
    query = stream.writeStream.option("checkpointLocation", f"{checkpoint}/state").foreachBatch(emit).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
