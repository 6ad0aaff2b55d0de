"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so a cosine threshold is a distance epsilon. Vectors are projected on
a few leading principal directions (distances can only shrink there), cut into grid cells of side epsilon and sorted by
cell. Intervals of that sequence are joined with each other recursively: a pair of intervals whose projected boxes
are more than epsilon apart is skipped with all it holds. The recursion runs in Spark joins down to blocks and inside a task
from a block down to runs of RUN vectors. Surviving pairs of runs are compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import components, stored

COSINE = 0.93
DIRECTIONS = 4
#: The principal directions come from at most twice so many vectors. Any directions give the same links; these prune best.
SAMPLE = 4096
#: A block ends at so many vectors or so many bytes of them; a run is the last interval of the recursion.
BLOCK, BLOCK_BYTES = 8192, 16 << 20
FAN = 8
RUN = 64
#: Products this close to the threshold are computed again one by one.
MARGIN = 1e-9


def principal(sample: list, directions: int = DIRECTIONS) -> dict[int, np.ndarray]:
    """Leading orthonormal directions (columns) for each vector length in the sample."""
    found: dict[int, list] = {}
    for v in sample:
        found.setdefault(len(v), []).append(v)
    out = {}
    for dim, rows in found.items():
        x = unit(np.array(rows, dtype=np.float64))
        x -= x.mean(0)
        values, axes = np.linalg.eigh(x.T @ x)
        out[dim] = np.ascontiguousarray(axes[:, np.argsort(-values)[:directions]])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blocks(distinct: DataFrame, axes: dict[int, np.ndarray], epsilon: float, directions: int) -> DataFrame:
    """Rows (block, dim, label, lo, hi, reps, weights, points, data): intervals of the grid order of one label and dimension."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(x.values, dtype=np.float64) for x in batch.column(3)]
            points = []
            for v in lists:
                a = axes.get(len(v))
                p = unit(v[None, :])[0]
                p = p @ a if a is not None else p[:directions]
                points.append(np.pad(p, (0, directions - len(p))))
            points = np.array(points).reshape(len(lists), directions)
            cells = np.floor(points / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(v) for v in lists], pa.int32()),
                    pa.array([v.tobytes() for v in lists], pa.binary()),
                    pa.array(list(cells), pa.list_(pa.int64())),
                    pa.array(list(points), pa.list_(pa.float64())),
                ],
                ["label", "rep", "weight", "dim", "data", "cell", "point"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, key, rows = 0, None, []

        def done() -> pa.RecordBatch:
            points = np.array([r["point"] for r in rows])
            columns = [
                [made], [rows[0]["label"]], [rows[0]["dim"]], [points.min(0)], [points.max(0)],
                [[r["rep"] for r in rows]], [[r["weight"] for r in rows]], [points.tobytes()], [b"".join(r["data"] for r in rows)],
            ]
            kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.list_(pa.int64())] * 2, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["run", "label", "dim", "lo", "hi", "reps", "weights", "points", "data"])

        for batch in batches:
            for r in batch.to_pylist():
                if rows and ((r["label"], r["dim"]) != key or len(rows) >= min(BLOCK, BLOCK_BYTES // (8 * r["dim"]))):
                    yield done()
                    made, rows = made + 1, []
                key = r["label"], r["dim"]
                rows.append(r)
        if rows:
            yield done()

    points = distinct.select("label", "rep", "weight", "embedding").mapInArrow(
        project, "label string, rep long, weight long, dim int, data binary, cell array<long>, point array<double>"
    )
    order = ["label", "dim", *[F.col("cell")[i] for i in range(directions)], "rep"]
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (
        points.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(cut, "run long, label string, dim int, lo array<double>, hi array<double>, reps array<long>, weights array<long>, points binary, data binary")
    )
    # partitions follow the grid order, and so do these numbers
    return stored(runs.withColumn("block", F.spark_partition_id().cast("long") * (1 << 20) + F.col("run")), "blocks")


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a <= b) of blocks of one label whose boxes are at most epsilon apart, found from the top intervals down."""
    boxes = stored(blocks.select("block", "label", "dim", "lo", "hi"), "boxes")
    ranks = boxes.select("block", F.shiftright("block", 20).alias("part"), (F.col("block").bitwiseAND(F.lit((1 << 20) - 1))).alias("run"))
    top = ranks.agg(F.max("part").alias("part"), F.max("run").alias("run")).first()
    span = (top["run"] or 0) + 1
    number = F.shiftright("block", 20) * span + F.col("block").bitwiseAND(F.lit((1 << 20) - 1))
    leaf = boxes.select("label", "dim", "lo", "hi", "block", number.alias("node"))
    depth = max(1, math.ceil(math.log(max(2, ((top["part"] or 0) + 1) * span), FAN)))
    size = len((boxes.select("lo").first() or [[0] * DIRECTIONS])[0])

    def level(k: int) -> DataFrame:
        """Intervals of FAN ** k block numbers."""
        up = leaf.withColumn("node", F.expr(f"node div {FAN ** k}")) if k else leaf
        lows = F.array(*[F.min(F.col("lo")[i]) for i in range(size)])
        highs = F.array(*[F.max(F.col("hi")[i]) for i in range(size)])
        return up.groupBy("label", "dim", "node").agg(lows.alias("lo"), highs.alias("hi"))

    def near(a: str, b: str):
        gap = F.zip_with(
            F.zip_with(f"{a}.lo", f"{b}.hi", lambda x, y: x - y),
            F.zip_with(f"{b}.lo", f"{a}.hi", lambda x, y: x - y),
            lambda x, y: F.greatest(x, y, F.lit(0.0)),
        )
        square = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
        return square <= (epsilon + 1e-9) ** 2

    pairs = level(depth).select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for k in range(depth - 1, -1, -1):
        nodes = level(k).withColumn("up", F.expr(f"node div {FAN}")).withColumn("box", F.struct("lo", "hi"))
        left = nodes.select("label", "dim", F.col("up").alias("a"), F.col("node").alias("na"), F.col("box").alias("x"))
        right = nodes.select("label", "dim", F.col("up").alias("b"), F.col("node").alias("nb"), F.col("box").alias("y"))
        pairs = (
            pairs.join(left, ["label", "dim", "a"])
            .join(right, ["label", "dim", "b"])
            .where(F.col("na") <= F.col("nb"))
            .where(near("x", "y"))
            .select("label", "dim", F.col("na").alias("a"), F.col("nb").alias("b"))
        )
    named = leaf.select("node", "block")
    return stored(
        pairs.join(named.select(F.col("node").alias("a"), F.col("block").alias("left")), "a")
        .join(named.select(F.col("node").alias("b"), F.col("block").alias("right")), "b")
        .select("left", "right"),
        "pairs",
    )


def near_runs(a: np.ndarray, b: np.ndarray, epsilon: float, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of runs of the points ``a`` and ``b`` whose boxes are at most ``epsilon`` apart.

    Intervals of both sides are met from the whole down to runs, FAN parts at a time; a pair too far apart goes with all it holds.
    """

    def boxes(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at = np.arange(0, len(points), run)
        levels = [(np.minimum.reduceat(points, at), np.maximum.reduceat(points, at))]
        while len(levels[-1][0]) > 1:
            low, high = levels[-1]
            at = np.arange(0, len(low), FAN)
            levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        return levels

    left, right = boxes(a), boxes(b)
    depth = max(len(left), len(right))
    left += [left[-1]] * (depth - len(left))
    right += [right[-1]] * (depth - len(right))
    i = j = np.zeros(1, np.int64)
    for level in range(depth - 1, -1, -1):
        for side, levels in ((0, left), (1, right)):
            if level + 1 < depth and levels[level] is not levels[level + 1]:  # one interval of the level above is FAN here
                mine, other = (i, j) if side == 0 else (j, i)
                mine = (mine[:, None] * FAN + np.arange(FAN)).ravel()
                other = np.repeat(other, FAN)
                real = mine < len(levels[level][0])
                i, j = (mine[real], other[real]) if side == 0 else (other[real], mine[real])
        (la, ha), (lb, hb) = left[level], right[level]
        gap = np.maximum(0.0, np.maximum(la[i] - hb[j], lb[j] - ha[i]))
        near = (gap * gap).sum(axis=1) <= (epsilon + 1e-9) ** 2
        i, j = i[near], j[near]
    return i, j


def compare(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of linked rows, run by run; for ``same`` each row also meets itself, which is left out."""
    ux, uy = unit(x), unit(y)
    left, right = near_runs(px, py, math.sqrt(2 - 2 * cosine), RUN)
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    for k in np.unique(left).tolist():
        met = right[np.searchsorted(left, k) : np.searchsorted(left, k, side="right")]
        rows = (met[:, None] * RUN + np.arange(RUN)).ravel()
        rows = rows[rows < len(y)]
        found = ux[k * RUN : (k + 1) * RUN] @ (uy if len(rows) == len(uy) else uy[rows]).T
        i, j = np.nonzero(found >= cosine - MARGIN)
        close = np.flatnonzero(np.abs(found[i, j] - cosine) <= MARGIN)
        i, j = i + k * RUN, rows[j]
        drop = [
            n for n in close.tolist()
            if float(x[i[n]] @ y[j[n]]) / math.sqrt(float(x[i[n]] @ x[i[n]]) * float(y[j[n]] @ y[j[n]])) < cosine
        ]
        keep = np.ones(len(i), bool)
        keep[drop] = False
        if same:
            keep &= i != j
        yield i[keep], j[keep]


def _compared(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """Rows (edge, a, b): links of representative a summed up in b, or with ``edge`` a spanning edge (a, b)."""
    from veldt.llm.simhash_links import join_labels

    side = lambda name: blocks.select(F.col("block").alias(name), F.struct("dim", "reps", "weights", "points", "data").alias(f"{name}_"))
    joined = pairs.join(side("left"), "left").join(side("right"), "right")

    def vectors(b: dict) -> tuple[np.ndarray, np.ndarray]:
        rows = len(b["reps"])
        return np.frombuffer(b["data"], dtype=np.float64).reshape(rows, -1), np.frombuffer(b["points"], dtype=np.float64).reshape(rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                p, q, same = row["left_"], row["right_"], row["left"] == row["right"]
                reps = np.array(p["reps"] + ([] if same else q["reps"]), np.int64)
                weights = np.array(p["weights"] + ([] if same else q["weights"]), np.int64)
                shift = 0 if same else len(p["reps"])
                counts, label = (weights - 1 if same else np.zeros(len(reps), np.int64)), np.arange(len(reps))
                (x, px), (y, py) = vectors(p), vectors(q)
                for i, j in compare(x, y, px, py, same, cosine):
                    j = j + shift
                    np.add.at(counts, i, weights[j])
                    if not same:
                        np.add.at(counts, j, weights[i])
                    join_labels(label, i, j)
                some, own = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(reps)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.zeros(len(some), bool), np.ones(len(own), bool)])),
                        pa.array(np.concatenate([reps[some], reps[label[own]]])),
                        pa.array(np.concatenate([counts[some], reps[own]])),
                    ],
                    ["edge", "a", "b"],
                )

    return stored(joined.select("left", "right", "left_", "right_").mapInArrow(run, "edge boolean, a long, b long"), "compared")


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, directions: int = DIRECTIONS
) -> DataFrame:
    """One row per row of ``vectors``: (key, n_links, component_id, kept).

    Two vectors link if their labels are equal and not null and their cosine in double precision is at least ``cosine``
    (which is to be positive). Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label or key, link with nothing; vectors of different lengths don't link. Rows that repeat a key and
    its vector count as vectors of their own; a key with several vectors is one node, and their links add up. component_id is the smallest key reachable by links, kept tells whether that is the row's own.

    Equal vectors of a label collapse to one representative with a weight before the join, so a group of copies of any size
    costs one row there; links and not pairs are counted, and only spanning edges leave a task. A hot label is cut into
    blocks like all others. Any number type is compared as doubles.
    """
    value = F.col(vector).cast("array<double>")
    fine = (
        F.col(key).isNotNull()
        & F.col(label).isNotNull()
        & F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))
    )
    rows = vectors.select(F.col(key).alias("key"), F.when(fine, F.col(label).cast("string")).alias("label"), F.when(fine, value).alias("embedding"))
    rows = rows.select("key", "label", F.xxhash64(F.lit(1), "embedding").alias("k1"), F.xxhash64(F.lit(2), "embedding").alias("k2"), "embedding")
    distinct = stored(
        rows.where("label IS NOT NULL")
        .groupBy("label", "k1", "k2")
        .agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")),
        "vectors",
    )
    epsilon = math.sqrt(2 - 2 * cosine)
    every = max(1, distinct.count() // SAMPLE)
    chosen = distinct.where(F.pmod(F.xxhash64("rep", "label"), F.lit(every)) == 0)
    sample = [r[0] for r in chosen.select("embedding").limit(2 * SAMPLE).collect()]
    blocks = _blocks(distinct, principal(sample, directions), epsilon, directions)
    compared = _compared(_block_pairs(blocks, epsilon), blocks, cosine)
    links = compared.where("NOT edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n_links"))
    found = components(compared.where("edge").select("a", "b")).withColumnRenamed("node", "rep")
    named = (
        distinct.select("label", "k1", "k2", "rep")
        .join(links, "rep", "left")
        .join(found, "rep", "left")
        .select("label", "k1", "k2", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.select("key", "label", "k1", "k2").join(named, ["label", "k1", "k2"], "left")
    component = F.coalesce("component_id", "key")
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("key") == component).alias("kept")
    )


ORACLE = f"""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}),
r AS (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a) SELECT a, min(b) AS m FROM t GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(r.m, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(r.m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = e.vec_id LEFT JOIN r ON r.a = e.vec_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
