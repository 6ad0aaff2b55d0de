"""Packing of documents into fixed-length sequences: first-fit decreasing in randomised groups.

Documents are dealt to groups by a hash of their key, so that a group is a random sample of the corpus and packs
as well as the whole would. Inside a group the pieces go by length, longest first, each into the first sequence
with enough room; a tournament tree over the sequences' free room finds that sequence in log(n) steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.bpe_codec import Encoder, default_tokenizer
from veldt.llm.common import slices

CAPACITY = 4096
END_ID = 2
GROUP_DOCS = 4096
SEED = 17
#: Sequence ids: the group's number times this, plus the number inside the group.
GROUP_SPAN = 1 << 32


class FirstFit:
    """A tournament tree over bin capacities: every inner node holds the largest free room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset): the first bin with room for ``length``; there is always one while bins >= pieces."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        offset = self.capacity - room[node]
        room[node] -= length
        found = node - self.leaves
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
        return found, offset


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Ties keep the given order. Every length is from 1 to ``capacity``."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return bins, offsets
    tree = FirstFit(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], offsets[i] = tree.put(int(lengths[i]))
    return bins, offsets


def cut(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document's ids with ``end_id`` behind them: full pieces of ``capacity`` and the rest.

    Rows (key, start, length, ids_crc32, doc_tokens, row_id): the ids stay whole, each in exactly one piece. A null or
    empty text is the end id alone. row_id tells rows with equal keys apart.
    """
    path = path or default_tokenizer()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * capacity
        for rows in slices(batches, 2, 4096, 6 << 20):
            ids, stop = encoder.encode(rows.column(2))
            at, found, last = [], [], 0
            for i, after in enumerate(stop.tolist()):
                whole = ids[last:after].tobytes() + end
                last = after
                for start in range(0, len(whole), step):
                    piece = whole[start : start + step]
                    at.append(i)
                    found.append((start // 4, len(piece) // 4, zlib.crc32(piece), len(whole) // 4))
            taken = rows.take(pa.array(at, pa.int64()))
            columns = [pa.array(c, pa.int64()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([taken.column(0), *columns, taken.column(1)], ["key", "start", "length", "ids_crc32", "doc_tokens", "row_id"])

    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, row_id long"
    body = F.col(text).cast("string")
    # rows that repeat key and text need numbers of their own, to be dealt apart
    number = F.xxhash64(F.col(key), body, F.monotonically_increasing_id())
    return docs.select(F.col(key).alias("key"), number.alias("row_id"), body.alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens; one row per piece.

    Returns (key, start, length, ids_crc32, doc_tokens, sequence_id, offset): the piece holds the document's ids from
    ``start`` on and lies at ``offset`` of its sequence; a sequence has no gaps. Only these numbers are shuffled, never
    text or ids. The number of groups follows the number of documents, so that a group has about ``group_docs`` of them;
    groups are dealt by a hash of key, text and piece, so no
    key or source makes a group large and the pieces of one very long document spread. Null keys and texts are packed like others; an empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group_docs))
    pieces = cut(docs, path, key, text, capacity, end_id)
    # pieces of one very long or often repeated document need not stay together
    group = F.pmod(F.xxhash64(F.lit(SEED), "row_id", "start"), F.lit(groups))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_id", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = pdf["group"].to_numpy() * GROUP_SPAN + bins
        pdf["offset"] = offsets
        return pdf.drop(columns=["group", "row_id"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.withColumn("group", group).groupBy("group").applyInPandas(place, schema).withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs)
