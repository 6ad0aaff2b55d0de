"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are 64 bits. Distinct fingerprints are dealt to buckets by five bit bands; two fingerprints that
differ in at most four bits agree on one band at least, so no link is lost. Inside a bucket they are sorted by Gray
rank, which puts similar patterns side by side, and indexed: a node keeps the bits that all its members share (mask
and pattern), upper nodes share what their children share. A pair of nodes whose shared patterns already differ in
more than four bits is pruned with all its members; differences are counted once, where the bit is first shared, and add up on the way down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import components, doubtful, slices, spread_join, stored, without

WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
BANDS = MAX_BITS + 1
#: What the pipeline's stage takes: runs of so many words, their similarity, and how far fingerprints of candidates may differ.
SHINGLE, SIMILARITY, NEAR_BITS = 5, 0.8, 6
LEAF = 32
FAN = 8
SLOT_ROWS = 4096
#: A bucket above this size is dealt again by its other bits.
BUCKET_ROWS = 20_000
PAIRS_AT_ONCE = 1000
#: Runs of words are counted in so many bins, each up to FULL, before texts are compared by their runs.
BINS, FULL = 64, 65_535


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the ``words``-word shingles of a UTF-8 text: A-Z in lower case, words split at ASCII white space."""
    # bytes.lower() and bytes.split() know ASCII letters and white space only
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, HASH_SEED)], dtype="<u8")
        return _majority(hashes)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    hashed, seed = xxhash.xxh64_intdigest, HASH_SEED
    return _majority(np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts, stops)), "<u8", len(starts)))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (key, fp long): the signed form of each whole text's fingerprint; zero for null or wordless texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", words) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over fingerprints in Gray order: blocks of LEAF, upper nodes over FAN nodes each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        starts = np.arange(0, len(codes), LEAF)
        ones, zeros = np.bitwise_and.reduceat(codes, starts), np.bitwise_and.reduceat(~codes, starts)
        self.levels = [(ones, zeros)]
        while len(ones) > 1:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones, zeros))

    def block_pairs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i <= j) of leaf blocks that may hold codes at most ``most`` bits apart."""
        left = right = sofar = np.zeros(1, np.int64)
        above = self.levels[-1]
        # the root's own pattern differs from itself nowhere, so the count starts at zero
        for ones, zeros in reversed(self.levels[:-1]):
            child = np.arange(FAN)
            pair = np.repeat(np.arange(len(left)), FAN * FAN)
            a = (left[:, None, None] * FAN + child[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
            b = (right[:, None, None] * FAN + child[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
            ok = (a < len(ones)) & (b < len(ones)) & (a <= b)
            a, b, pair = a[ok], b[ok], pair[ok]
            up, across = a // FAN, b // FAN
            # what the parents share was counted above; a node adds the bits that its own members share beyond that
            told = (above[0][up] | above[1][up]) & (above[0][across] | above[1][across])
            count = sofar[pair] + np.bitwise_count(((ones[a] & zeros[b]) | (zeros[a] & ones[b])) & ~told)
            near = count <= most
            left, right, sofar, above = a[near], b[near], count[near], (ones, zeros)
        return left, right


def linked(codes: np.ndarray, most: int = MAX_BITS, finer: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For codes in Gray order: (position of the first member of each code's connected group, of its best partner).

    The best partner is the linked code that is least bits apart in ``finer``, the first of equal ones; a code without links,
    or all without ``finer``, have themselves.
    """
    n = len(codes)
    label, best = np.arange(n), np.full(n, np.iinfo(np.int64).max)
    left, right = GrayIndex(codes).block_pairs(most)
    blocks = -(-n // LEAF)
    padded = np.zeros(blocks * LEAF, np.uint64)
    padded[:n] = codes
    padded = padded.reshape(blocks, LEAF)
    for at in range(0, len(left), PAIRS_AT_ONCE):
        a, b = left[at : at + PAIRS_AT_ONCE], right[at : at + PAIRS_AT_ONCE]
        k, i, j = np.nonzero(np.bitwise_count(padded[a][:, :, None] ^ padded[b][:, None, :]) <= most)
        i, j = a[k] * LEAF + i, b[k] * LEAF + j
        real = (i < n) & (j < n) & (i != j)
        i, j = i[real], j[real]
        join_labels(label, i, j)
        if finer is not None:
            apart = np.bitwise_count(finer[i] ^ finer[j]).astype(np.int64) * n
            np.minimum.at(best, i, apart + j)
            np.minimum.at(best, j, apart + i)
    return label, np.where(best == np.iinfo(np.int64).max, np.arange(n), best % max(n, 1))


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the groups of each pair (i, j) in place; ``label`` points straight to the first member of a group."""
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        new = low != high
        if not new.any():
            return
        np.minimum.at(label, high[new], low[new])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _band_bits(bands: int) -> list[tuple[int, int]]:
    """(shift, width) of each band of 64 bits."""
    edges = [64 * i // bands for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _band(code: str, bands: int):
    """Column: array of (band number, band value) packed into one long each."""
    return F.array(
        *[
            F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
            for i, (shift, width) in enumerate(_band_bits(bands))
        ]
    )


def links(distinct: DataFrame, most: int = MAX_BITS, finer: str | None = None) -> DataFrame:
    """Edges (a, b) of longs between representatives; ``distinct`` has rows (fp, rep).

    With ``finer``, a second fingerprint, there is also an edge from each to the linked one of its bucket that is least bits
    apart in it.

    Edges span each group of linked fingerprints of a bucket as a star, so a large group makes as many edges as it
    has members and never all pairs. A bucket above the limit is dealt again by finer bands of its other bits, which
    again lose no link. There are at most ``most + 1`` times 2 ** 13 buckets, which bounds the broadcast list of the large ones.
    """
    second = F.col(finer) if finer else F.lit(0).cast("long")
    keyed = _dealt(distinct.select("fp", "rep", second.alias("finer")), most)

    def run(table: pa.Table) -> pa.Table:
        codes, reps, more, _, buckets = _buckets(table, "finer")
        left, right = [], []
        for a, b in buckets:
            for other in linked(codes[a:b], most, more[a:b].view(np.uint64) if finer else None):
                own = np.flatnonzero(other != np.arange(b - a))
                left.append(reps[a:b][other[own]])
                right.append(reps[a:b][own])
        empty = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([empty, *left]), "b": np.concatenate([empty, *right])})

    return keyed.groupBy("slot").applyInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with a fingerprint ``fp`` once for each of their buckets (band, sub), and the slot that the bucket lies in."""
    columns = rows.columns
    slots = max(32, (most + 1) * rows.count() // SLOT_ROWS)
    coarse = rows.select(*columns, F.explode(_band("fp", most + 1)).alias("band"))
    large = coarse.groupBy("band").count().where(F.col("count") > BUCKET_ROWS).select("band")
    # each band is two fine bands wide; of the fine bands outside the bucket's own, most + 1 are enough, since
    # most differing bits can't touch all of them
    fine = _band("fp", 2 * (most + 1))
    own = F.shiftright("band", 32).cast("int")
    outside = F.slice(F.concat(fine, fine), own * 2 + 3, most + 1)
    return (
        coarse.join(F.broadcast(large.withColumn("large", F.lit(True))), "band", "left")
        .select(*columns, "band", F.explode(F.when(F.col("large"), outside).otherwise(F.array(F.lit(-1).cast("long")))).alias("sub"))
        .withColumn("slot", F.pmod(F.xxhash64("band", "sub"), F.lit(slots)))
    )


def _buckets(table: pa.Table, more: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(fingerprints, rep, the column ``more``, order of the rows, ends of each bucket of more than one row) of a slot's rows, in Gray order in each bucket."""
    band, sub = (table.column(c).to_numpy() for c in ("band", "sub"))
    codes, reps = table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy()
    order = np.lexsort((reps, gray_rank(codes), sub, band))
    band, sub = band[order], sub[order]
    edge = np.flatnonzero((band[1:] != band[:-1]) | (sub[1:] != sub[:-1])) + 1
    buckets = [(a, b) for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(order)]) if b - a > 1]
    return codes[order], reps[order], table.column(more).to_numpy()[order], order, buckets


def pairs_across(rows: DataFrame, most: int, least: float) -> DataFrame:
    """All pairs (a, b), a below b, of ``rows`` (fp, rep, component, bins) at most ``most`` bits apart and of different components, that may have a similarity of ``least``.

    ``bins`` are ``binned`` runs of words: two sets have in common at most the sum of the lesser counts of each bin. Pairs leave a
    bucket in batches, so a task holds its bucket and not its pairs; a pair that meets in several bands is told in the first.
    """
    bits = _band_bits(most + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        codes, reps, part, order, buckets = _buckets(table, "component")
        band = table.column("band").to_numpy()[order] >> 32
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint16).reshape(-1, BINS)[order]
        sizes = bins.sum(1, dtype=np.int64)
        full = (bins == FULL).any(1)  # such a count is a lower bound only
        for start, end in buckets:
            code, n = codes[start:end], end - start
            if (part[start:end] == part[start]).all():
                continue
            left, right = GrayIndex(code).block_pairs(most)
            inside = np.arange(LEAF)
            for at in range(0, len(left), PAIRS_AT_ONCE):
                i = (left[at : at + PAIRS_AT_ONCE, None, None] * LEAF + inside[:, None] + 0 * inside).ravel()
                j = (right[at : at + PAIRS_AT_ONCE, None, None] * LEAF + inside + 0 * inside[:, None]).ravel()
                ok = (i < j) & (j < n)
                i, j = i[ok], j[ok]
                apart = code[i] ^ code[j]
                ok = (np.bitwise_count(apart) <= most) & (part[start:end][i] != part[start:end][j])
                for shift, width in bits[: band[start]]:
                    ok &= (apart >> np.uint64(shift)) & np.uint64((1 << width) - 1) != 0
                i, j = i[ok] + start, j[ok] + start
                for first in range(0, len(i), PAIRS_AT_ONCE):
                    x, y = i[first : first + PAIRS_AT_ONCE], j[first : first + PAIRS_AT_ONCE]
                    common = np.minimum(bins[x], bins[y]).sum(1, dtype=np.int64)
                    ok = full[x] | full[y] | (common >= (sizes[x] + sizes[y] - common) * least)
                    a, b = reps[x[ok]], reps[y[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _dealt(rows, most).groupBy("slot").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, most: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: (key, fp, component_id), the component being the smallest key reachable by links.

    Fingerprints link at ``most`` or fewer differing bits. ``key`` is a long. Null, empty and wordless texts have
    fingerprint zero and link like others. Rows that repeat a key each get a row. A null key gets a row too; its
    component is the smallest key of the group, or null if the group has none. Equal fingerprints collapse to one
    representative before the search, so a group of copies of any size costs one row there. An empty table gives no rows.
    """
    printed = stored(fingerprints(docs, key, text, words), "fingerprints")
    distinct = printed.groupBy("fp").agg(F.min("key").alias("rep"))
    distinct = stored(distinct, "distinct")
    edges = links(distinct.where("rep IS NOT NULL"), most)
    found = components(edges)
    named = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return printed.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def word_print(words: list[bytes]) -> int:
    """SimHash of the different words of a text, each once; zero without words."""
    return _majority(np.fromiter((xxhash.xxh64_intdigest(w, HASH_SEED) for w in set(words)), "<u8")) if words else 0


def shape(words: list[bytes]) -> int:
    """A signed 64-bit number of a sequence of words; equal sequences have the same."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).astype(np.int64))


def shingle_hashes(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different runs of ``n`` words; of a shorter text the whole is one."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= n:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64).view(np.int64)
    starts = np.concatenate(([0], ends[:-n] + 1)).tolist()
    found = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts, ends[n - 1 :].tolist())), np.uint64, len(starts))
    return np.unique(found).view(np.int64)


def binned(runs: np.ndarray) -> bytes:
    """How many hashes lie in each of BINS bins, as unsigned 16-bit numbers; FULL stands for as many and more."""
    counts = np.bincount((runs.view(np.uint64) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return np.minimum(counts, FULL).astype(np.uint16).tobytes()


def _words(column: pa.Array) -> Iterator[list[bytes]]:
    for t in column.cast(pa.binary()):
        yield (t.as_py() or b"").lower().split()


def _shapes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, node, fp, finer): the shape of each text, the fingerprints of its words and of its runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [(shape(w), word_print(w), int(_majority(shingle_hashes(w).view(np.uint64)))) for w in _words(batch.column(1))]
            prints = [np.array([x[k] for x in found], np.uint64).view(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), *map(pa.array, prints)], ["key", "node", "fp", "finer"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, node long, fp long, finer long")


def _runs(edges: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Rows (node, runs, bins): the runs of ``words`` words of the texts that stand at an edge, one for each node."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    wanted = stored(ends.join(nodes, "node").select("node", F.col("rep").alias("__rep")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = [(shape(w), shingle_hashes(w, words)) for w in _words(batch.column(0))]
            kinds = pa.int64(), pa.list_(pa.int64()), pa.binary()
            columns = [n for n, _ in found], [x for _, x in found], [binned(x) for _, x in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["node", "runs", "bins"])

    few = doubtful(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), wanted.select("__rep"), "key", "hit").where("hit").select("text")
    runs = few.mapInArrow(run, "node long, runs array<long>, bins binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return stored(runs, "runs")


def _similar(edges: DataFrame, runs: DataFrame, least: float) -> DataFrame:
    """Those edges (a, b) whose texts' ``runs`` (node, runs) have a Jaccard similarity of ``least`` or more."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    met = ends.groupBy("node").agg(F.count(F.lit(1)).alias("met"))
    runs = stored(runs.select("node", "runs").join(met, "node"), "runs")
    total = 2 * edges.count()
    side = lambda name: runs.select(F.col("node").alias(name), F.col("runs").alias(f"{name}_runs"), "met")
    pairs = spread_join(edges, side("a"), "a", "met", total, F.col("b"), "inner").drop("met")
    pairs = spread_join(pairs, side("b"), "b", "met", total, F.col("a"), "inner")
    common = F.size(F.array_intersect("a_runs", "b_runs"))
    return pairs.where(common >= (F.size("a_runs") + F.size("b_runs") - common) * least).select("a", "b")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, least: float = SIMILARITY, most: int = NEAR_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one whose key is the group's smallest.

    Texts are linked if their runs of ``words`` words have a Jaccard similarity of ``least`` or more; links chain. The Gray-order
    index names the pairs to compare, those whose fingerprints of different words are ``most`` or fewer bits apart: at first each text beside the
    first of its group in a bucket and the one most like it by the fingerprint of its runs, in every band, and then all pairs that these links leave in
    different groups. Words are lower-cased (A-Z) and parted by ASCII white space. Texts of the same words,
    null and empty ones among each other, are one text there. Of rows that repeat the smallest key, all whose text belongs to the group stay. Rows with
    a null key always stay. Groups are of texts, so rows that share a key but not a text don't tie their groups together, and
    each is judged by its own.
    """
    # all columns travel in one struct, so that their names may be any
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    shapes = stored(_shapes(rows, "key", "text"), "shapes")
    nodes = stored(shapes.groupBy("node").agg(F.min("key").alias("rep"), F.first("fp").alias("fp"), F.first("finer").alias("finer")), "nodes")
    pairs = links(nodes.where("rep IS NOT NULL").select("fp", "finer", F.col("node").alias("rep")), most, "finer")
    edges = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    runs = _runs(edges, nodes, rows, "key", "text", words)
    alike = stored(_similar(edges, runs, least), "alike")
    found = components(alike)
    # a text with another within reach stands at an edge; of those in reach all that no link has joined so far are compared
    parts = runs.select("node", "bins").join(nodes.select("node", "fp"), "node").join(found, "node", "left")
    across = pairs_across(parts.select("fp", F.col("node").alias("rep"), F.coalesce("component", "node").alias("component"), "bins"), most, least)
    more = stored(across.join(edges, ["a", "b"], "left_anti"), "across")
    if not more.isEmpty():
        found = components(alike.unionByName(_similar(more, runs, least)))
    rooted = nodes.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    first = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("first")), "root").select("node", "first")
    judged = shapes.where("key IS NOT NULL").join(first, "node")
    lost = stored(judged.where("key <> first").select(F.col("key").alias("__lost")).distinct(), "lost")
    # keys that stand both on a row to drop and on one that stays: rare, so only their rows are told apart by their text
    stay = judged.where("key = first").join(lost, F.col("key") == F.col("__lost"), "left_semi").select(F.col("key").alias("__key"), F.col("node").alias("__node")).distinct()
    kept = without(rows.select("row", "key"), lost, "key").select("row.*")
    stay = stored(stay, "stay")
    if stay.isEmpty():
        return kept
    told = rows.join(stay.select("__key").distinct(), F.col("key") == F.col("__key"), "left_semi").withColumn("shape", _shape_of(F.col("text").cast("binary")))
    back = told.join(stay, (F.col("key") == F.col("__key")) & (F.col("shape") == F.col("__node")), "left_semi").select("row.*")
    return kept.union(back)


@F.pandas_udf(T.LongType())
def _shape_of(texts: pd.Series) -> pd.Series:
    """The shape of each text (its bytes)."""
    return pd.Series([shape((t or b"").lower().split()) for t in texts], dtype="int64")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
