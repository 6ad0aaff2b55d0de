"""Substring dedup by level-wise doubling: quarter, half and full windows.

A window that is repeated is made of two halves that are repeated, and these of quarters. The search starts with windows of a
quarter of the length (5 words of 20): only where one is met more than once are windows of twice that length formed and counted, and only
where these repeat the full windows. Each word of a longer repeat lies in a repeated full window, so removal ends there;
``longest_repeats`` doubles on from the full window until no candidate survives.

Below the full length not all windows are counted: of the half windows inside a full window the one with the least hash stands
for it, and in the same way a quarter for that half. Equal windows hold equal parts and so choose the same ones; if the chosen
part is met once only, the window is unique. About one position in six is chosen, which spares most of the shuffle.

Hashes of parts only prune. Full windows are told apart by 128-bit BLAKE2 digests of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import Tables, slices, spread_join, stored

WINDOW = 20
#: An odd multiplier for rolling hashes.
MULTIPLIER = 0x9E3779B97F4A7C15
WINDOWS_AT_ONCE = 1 << 17


class Words:
    """The words of several texts as one array; ``ends`` tells where each text's words end."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        flat = lists.flatten()
        real = pc.greater(pc.binary_length(flat), 0)  # white space at an end makes an empty word
        count = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
        self.ends = count[np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        self.flat = flat.filter(real)
        self.text = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def hashes(self) -> np.ndarray:
        coded = self.flat.dictionary_encode()
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        return own[coded.indices.to_numpy()]

    def windows(self, length: int) -> np.ndarray:
        """Positions where a window of ``length`` words of one text starts."""
        return np.flatnonzero(np.arange(len(self.text)) + length <= self.ends[self.text])

    def joined(self) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """(all words with one blank between in UTF-8, where each begins, where each ends)."""
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(self.flat)], pa.int32()), self.flat), " ")
        size = pc.binary_length(self.flat).to_numpy(zero_copy_only=False).astype(np.int64)
        stop = np.cumsum(size + 1) - 1
        return memoryview(whole[0].as_buffer()), stop - size, stop


def rolled(h: np.ndarray, length: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """Hash of every window of ``length`` words, by doubling: two neighbouring windows make one of twice the length."""
    power = {1: h}
    size = 1
    while 2 * size <= length:
        power[2 * size] = _joined(power[size], size, power[size], size, multiplier)
        size *= 2
    out, have = power[size], size
    for part in sorted(power, reverse=True):
        while have + part <= length:
            out, have = _joined(out, have, power[part], part, multiplier), have + part
    return out ^ (out >> np.uint64(29))


def _joined(a: np.ndarray, la: int, b: np.ndarray, lb: int, multiplier: int) -> np.ndarray:
    n = max(0, len(b) - la)
    return a[:n] * np.uint64(pow(multiplier, lb, 1 << 64)) + b[la : la + n]


def chosen(values: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """For each start the position of the least of the ``span`` values from there on."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(starts), WINDOWS_AT_ONCE):
        some = starts[at : at + WINDOWS_AT_ONCE]
        out.append(some + sliding_window_view(values, span)[some].argmin(axis=1))
    return np.concatenate(out)


class Parts:
    """The full windows of some texts, the half that stands for each of them and the quarter that stands for that half."""

    def __init__(self, words: Words, window: int):
        half = window // 2
        quarter = half // 2
        h = words.hashes()
        self.starts = words.windows(window)
        self.halves, self.quarters = rolled(h, half), rolled(h, quarter)
        self.half = chosen(self.halves, self.starts, window - half + 1)
        self.distinct = np.unique(self.half)
        self.quarter = chosen(self.quarters, self.distinct, half - quarter + 1)


def counted(keys: np.ndarray, text: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Rows (hash, n, key): how often each text holds each hash."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(text), 1), bool), (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))))
    n = np.diff(np.concatenate((first, [len(text)])))
    return pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(n), pa.array(keys[text[first]])], ["hash", "n", "key"])


def word_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, n_words, sha): the digest is of the words joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = Words(batch.column(1))
            whole, begin, stop = words.joined()
            sizes = np.diff(words.ends, prepend=0)
            spans = [(int(begin[b - n]), int(stop[b - 1])) if n else (0, 0) for b, n in zip(words.ends.tolist(), sizes.tolist())]
            shas = [hashlib.sha256(whole[a:b]).digest() for a, b in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary())], ["key", "n_words", "sha"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, n_words long, sha binary")


def _repeated(rows: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Rows (key, hashes): the hashes of each document that are met more than once in all of ``rows`` (hash, n, key)."""
    rows = stored(rows, name)
    total = rows.agg(F.sum("n")).first()[0] or 0
    again = stored(rows.groupBy("hash").agg(F.sum("n").alias("met")).where("met > 1"), f"{name}-again")
    found = spread_join(rows.select("hash", "key"), again, "hash", "met", total, F.col("key"), "inner")
    grouped = found.groupBy("key").agg(F.collect_list("hash").alias("hashes"))
    return tables.write(grouped.repartition(tables.buckets, "key"), name)


def _searched(docs: DataFrame, meta: DataFrame, tables: Tables, key: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(rows (key, mixed, text) of the texts to search, rows (key, mixed, copy) of documents that need a note)."""
    enough = meta.where(F.col("key").isNotNull() & (F.col("n_words") >= window))
    same = stored(enough.groupBy("sha").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("met")).where("met > 1"), "same")
    total = meta.count()
    mark = F.xxhash64("sha")
    status = (
        spread_join(enough, same, "sha", "met", total, F.col("key"), "left")
        .groupBy("key")
        .agg((F.min(mark) != F.max(mark)).alias("mixed"), F.coalesce(F.max(F.col("first") < F.col("key")), F.lit(False)).alias("copy"))
    )
    # keys shared by different texts are searched text by text
    status = stored(status.select("key", "mixed", (F.col("copy") & ~F.col("mixed")).alias("copy")), "status")
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).repartition(tables.buckets, "key")
    kept = status.where("NOT copy").select("key", "mixed").repartition(tables.buckets, "key")
    return tables.write(texts.join(kept, "key").select("key", "mixed", "text"), "searched"), status


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: (key, n_words, n_removed, kept, words_sha256).

    Words are runs of other than ASCII white space. Each word is removed that a window of ``window`` consecutive words
    covers whose word sequence also starts earlier: in a smaller key, or in the same document further to the left. All windows are
    judged on the input. ``kept`` has the kept words joined by one blank, or is null if nothing was removed (then the text's
    words are all kept); words_sha256 is then the digest of all words.

    ``key`` is a long. A null text has no words. A row with a null key is a document that nothing is compared with. Rows
    that repeat key and words are one document; rows that repeat a key with other words are told apart by their digest.
    Of documents with the same words only the one with the smallest key is searched: all words of the others are removed,
    if there are ``window`` of them. An empty table gives no rows.
    """
    if window < 4 or window % 4:
        raise ValueError("window must be a multiple of four")
    tables = Tables(docs.sparkSession)
    meta = stored(word_table(docs, key, text), "words")
    searched, status = _searched(docs, meta, tables, key, text, window)
    quarters = _repeated(searched.select("key", "text").mapInArrow(_quarters(window), "hash long, n long, key long"), tables, "quarters")
    longer = searched.join(quarters, "key").select("key", "hashes", "text").mapInArrow(_halves(window), "hash long, n long, key long")
    halves = _repeated(longer, tables, "halves")
    candidates = searched.join(halves, "key").select("key", "mixed", "hashes", "text")
    earliest = (
        candidates.mapInArrow(_first_windows(window), "h1 long, h2 long, key long, part long, start long")
        .groupBy("h1", "h2")
        .agg(F.min(F.struct("key", "part", "start")).alias("e"))
        .select("e.*")
    )
    winners = tables.write(earliest.groupBy("key").agg(F.collect_list(F.struct("part", "start")).alias("first")).repartition(tables.buckets, "key"), "winners")
    judged = candidates.join(winners, "key", "left").select("key", "mixed", "hashes", "text", "first.part", "first.start")
    changed = judged.mapInArrow(_judge(window), "key long, sha binary, n_removed long, kept string").dropDuplicates(["key", "sha"])
    done = meta.join(status.where("copy").select("key", "copy"), "key", "left").join(changed.withColumnRenamed("n_removed", "some"), ["key", "sha"], "left")
    whole = F.col("copy").isNotNull() & (F.col("n_words") >= window)
    out = stored(
        done.select(
            F.col("key").alias(key),
            "n_words",
            F.when(whole, F.col("n_words")).otherwise(F.coalesce("some", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
            F.lower(F.hex("sha")).alias("words_sha256"),
        ),
        "kept",
    )
    tables.drop()
    return out


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def _quarters(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = Words(batch.column(1))
            parts = Parts(words, window)
            at = np.unique(parts.quarter)
            yield counted(_keys(batch), words.text[at], parts.quarters[at])

    return run


def _halves(window: int):
    """Counts half windows whose quarter is repeated. What is repeated for one text is so for every text that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            words = Words(batch.column(2))
            parts = Parts(words, window)
            again = np.isin(parts.quarters[parts.quarter], _flat(batch.column(1)).view(np.uint64))
            at = parts.distinct[again]
            yield counted(_keys(batch), words.text[at], parts.halves[at])

    return run


def _candidates(batch: pa.RecordBatch, window: int) -> tuple[Words, np.ndarray]:
    """(the words, the starts of full windows whose half is repeated); columns of ``batch``: key, mixed, hashes, text."""
    words = Words(batch.column(3))
    parts = Parts(words, window)
    return words, parts.starts[np.isin(parts.halves[parts.half], _flat(batch.column(2)).view(np.uint64))]


def _parts_of(words: Words, mixed: np.ndarray) -> np.ndarray:
    """A number for each text that tells texts of one key apart; zero where the key has one text."""
    out = np.zeros(len(mixed), np.int64)
    for k in np.flatnonzero(mixed).tolist():
        own = words.flat.slice(int(words.ends[k - 1]) if k else 0, int(np.diff(words.ends, prepend=0)[k]))
        out[k] = int.from_bytes(hashlib.sha256(" ".join(own.to_pylist()).encode()).digest()[:7], "big")
    return out


def _first_windows(window: int):
    """The candidate windows of each task: digest and earliest place. A passage leaves a slice of texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, 1024, 4 << 20):
            words, starts = _candidates(batch, window)
            whole, begin, stop = words.joined()
            found = b"".join([hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(begin[starts].tolist(), stop[starts + window - 1].tolist())])
            digests = np.frombuffer(found, np.int64).reshape(-1, 2)
            text = words.text[starts]
            first = np.concatenate(([0], words.ends[:-1]))[text]
            columns = [digests[:, 0], digests[:, 1], _keys(batch)[text], _parts_of(words, batch.column(1).to_numpy(zero_copy_only=False))[text], starts - first]
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            new = np.ones(len(order), bool)
            new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in columns], ["h1", "h2", "key", "part", "start"])

    return run


def _judge(window: int):
    """Texts that lose words: a candidate window loses if it isn't the earliest of its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            words, starts = _candidates(batch, window)
            own = _parts_of(words, batch.column(1).to_numpy(zero_copy_only=False))
            begin = np.concatenate(([0], words.ends[:-1]))
            wins = np.zeros(len(words.text) + 1, bool)
            text = np.repeat(np.arange(batch.num_rows), batch.column(4).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            parts, places = _flat(batch.column(4)).astype(np.int64), _flat(batch.column(5)).astype(np.int64)
            fits = parts == own[text]
            wins[begin[text[fits]] + places[fits]] = True
            lost = starts[~wins[starts]]
            change = np.bincount(lost, minlength=len(words.text) + 1) - np.bincount(lost + window, minlength=len(words.text) + 1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.bincount(words.text[gone], minlength=batch.num_rows)
            some = np.flatnonzero(removed)
            left = np.concatenate(([0], np.cumsum(~gone)))
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], left[words.ends])), pa.int32()), words.flat.filter(pa.array(~gone))), " ")
            whole, first, stop = words.joined()
            shas = [hashlib.sha256(whole[int(first[begin[k]]) : int(stop[words.ends[k] - 1])]).digest() for k in some.tolist()]
            columns = [pa.array(_keys(batch)[some], pa.int64()), pa.array(shas, pa.binary()), pa.array(removed[some], pa.int64()), kept.take(pa.array(some)).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "sha", "n_removed", "kept"])

    return run


def longest_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (key, length): for each document with a repeated window the greatest length ``window`` * 2 ** k of a window met again.

    Every level counts only windows both of whose halves are repeated at the level before; the search ends when none is left.
    A window counts as met again if it stands in another document or at another place of the same one. Rows with a null key or
    text are left out; rows that repeat a key are one document's texts.
    """
    tables = Tables(docs.sparkSession)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    texts = tables.write(texts.repartition(tables.buckets, "key"), "texts")
    found, length = [], window
    rows = texts.select("key", F.lit(None).cast("array<long>").alias("hashes"), "text").mapInArrow(_whole_windows(window, None), "hash long, n long, key long")
    while True:
        again = _repeated(rows, tables, f"level{length}")
        if again.isEmpty():
            break
        found.append(again.select("key", F.lit(length).cast("long").alias("length")))
        length *= 2
        rows = texts.join(again, "key").select("key", "hashes", "text").mapInArrow(_whole_windows(length, length // 2), "hash long, n long, key long")
    if not found:
        tables.drop()
        return docs.sparkSession.createDataFrame([], f"{key} long, length long")
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    out = stored(everything.groupBy(F.col("key").alias(key)).agg(F.max("length").alias("length")), "longest")
    tables.drop()
    return out


def _whole_windows(length: int, half: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            words = Words(batch.column(2))
            h, at = words.hashes(), words.windows(length)
            if half:
                again = np.isin(rolled(h, half), _flat(batch.column(1)).view(np.uint64))
                at = at[again[at] & again[at + half]]
            yield counted(_keys(batch), words.text[at], rolled(h, length)[at])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs)
    digest = F.when(F.col("kept").isNull(), F.col("words_sha256")).otherwise(F.sha2("kept", 256))
    return found.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))
