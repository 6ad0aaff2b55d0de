"""Hard-negative mining: rows of other labels whose score lies in a window below that of an anchor's positives.

Vectors of whole numbers are put on a sphere: with one more component each has the norm of the longest, and the distance of a
query (whose added component is 0) falls as its inner product rises. A window of scores is then an annulus of distances, and
vantage-point trees answer it: a row's distance to a vantage point and the range of distances below a branch bound the score of
all its rows from both sides.

A top tree over a bounded sample (TOP_SAMPLE rows of least hashes, a documented bound; any sample gives the same result) deals all
rows to at most TOP_LEAVES cells and cells to blocks of about BLOCK rows; each block is a tree built once and written. Anchors of near
cells travel together. A batch of them names the blocks whose cell meets one of its windows, and a task takes the blocks of one
batch nearest first, visits in each the leaves nearest first, passes leaves outside the annulus or below the k-th best so far, and stops when
none is left. Nothing is approximate: scores are integer sums, bounds have slack for rounding and blocks are cut by nothing else.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows equal in id, label and vector count once;
rows of one id that differ are rows of their own. Shorter vectors are read as if filled up with zeros. Ties go to the smaller id.
An empty table gives no row. Scores are exact as long as they fit in 64 bits, and are cut to that range beyond.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import stored

TOP_SAMPLE, TOP_LEAVES = 8_192, 1_024
#: Rows of a block, of a leaf in its tree, anchors of a batch, and blocks that one task takes for a batch.
BLOCK, LEAF, BATCH, TILE = 4_096, 64, 2_048, 64
#: Components are cut to this raster.
RASTER = 256
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass
class Tree:
    """Nodes in an order in which parents come first. ``rows`` is the order of rows in which each leaf is one stretch."""

    rows: np.ndarray
    parent: list[int]
    #: Range of the distances of a node's rows from its parent's vantage point.
    low: list[float]
    high: list[float]
    #: Row of the node's vantage point (-1: a leaf), its children, and the stretch of ``rows`` below it.
    vantage: list[int]
    children: list[tuple[int, int]]
    stretch: list[tuple[int, int]]


def apart(a: np.ndarray, a_more: np.ndarray, b: np.ndarray, b_more: np.ndarray, longest: float) -> np.ndarray:
    """Distances of augmented rows ``a`` from augmented rows ``b``, all of the squared norm ``longest``."""
    return np.sqrt(np.maximum(2 * longest - 2 * (a @ b.T + np.outer(a_more, b_more)), 0.0))


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    return np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0.0))


def build(x: np.ndarray, longest: float, leaf: int) -> Tree:
    """A vantage-point tree: each node halves its rows by their distance from the row farthest from its first one."""
    more = augmented(x, longest)
    tree = Tree(np.arange(len(x)), [-1], [0.0], [0.0], [-1], [(-1, -1)], [(0, len(x))])
    todo = [0]
    while todo:
        node = todo.pop()
        first, end = tree.stretch[node]
        if end - first <= leaf:
            continue
        own = tree.rows[first:end]
        far = own[int(np.argmax(apart(x[own], more[own], x[own[:1]], more[own[:1]], longest)[:, 0]))]
        d = apart(x[own], more[own], x[[far]], more[[far]], longest)[:, 0]
        order = np.argsort(d, kind="stable")
        tree.rows[first:end] = own[order]
        half = (end - first) // 2
        tree.vantage[node] = int(far)
        tree.children[node] = (len(tree.parent), len(tree.parent) + 1)
        for a, b in ((0, half), (half, end - first)):
            todo.append(len(tree.parent))
            tree.parent.append(node)
            tree.low.append(float(d[order[a]]))
            tree.high.append(float(d[order[b - 1]]))
            tree.vantage.append(-1)
            tree.children.append((-1, -1))
            tree.stretch.append((first + a, first + b))
    return tree


class Router:
    """The top tree: which cell a row lies in, and how far a query is from each cell's rows."""

    def __init__(self, sample: np.ndarray, longest: float, leaves: int):
        self.longest, self.x = longest, sample
        self.tree = build(sample, longest, max(1, -(-len(sample) // leaves)))
        self.more = augmented(sample, longest)
        self.leaves = [n for n, v in enumerate(self.tree.vantage) if v < 0]
        self.number = {n: k for k, n in enumerate(sorted(self.leaves, key=lambda n: self.tree.stretch[n]))}
        self.points = [n for n, v in enumerate(self.tree.vantage) if v >= 0]
        self.paths = {self.number[n]: self._path(n) for n in self.leaves}

    def _path(self, node: int) -> list[int]:
        path = []
        while self.tree.parent[node] >= 0:
            node = self.tree.parent[node]
            path.append(node)
        return path[::-1]

    def _to(self, x: np.ndarray, more: np.ndarray, node: int) -> np.ndarray:
        v = [self.tree.vantage[node]]
        return apart(x, more, self.x[v], self.more[v], self.longest)[:, 0]

    def cells(self, x: np.ndarray) -> np.ndarray:
        found, more = np.zeros(len(x), np.int64), augmented(x, self.longest)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if self.tree.vantage[node] < 0:
                found[own] = self.number[node]
            elif len(own):
                inner, outer = self.tree.children[node]
                near = self._to(x[own], more[own], node) <= self.tree.high[inner]
                todo += [(inner, own[near]), (outer, own[~near])]
        return found

    def ranges(self, cell: int, x: np.ndarray) -> tuple[list[float], list[float]]:
        """Least and greatest distance of rows of a cell from the vantage points on its path."""
        more = augmented(x, self.longest)
        d = [self._to(x, more, n) for n in self.paths[cell]]
        return [float(v.min()) for v in d], [float(v.max()) for v in d]

    def bounds(self, q: np.ndarray, ranges: dict[int, tuple[list[float], list[float]]]) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) distances of queries from the rows of each cell of ``ranges``, by the cells in order."""
        zero = np.zeros(len(q))
        far = self.longest + np.einsum("ij,ij->i", q, q)
        d = {n: np.sqrt(np.maximum(far - 2 * (q @ self.x[self.tree.vantage[n]]), 0.0)) for n in self.points}
        low, high = [], []
        for cell in sorted(ranges):
            least, most = zero, np.full(len(q), np.inf)
            for n, a, b in zip(self.paths[cell], *ranges[cell]):
                least, most = np.maximum(least, np.maximum(d[n] - b, a - d[n])), np.minimum(most, d[n] + b)
            low.append(least)
            high.append(most)
        return np.stack(low, 1), np.stack(high, 1)


def score_range(low: np.ndarray, high: np.ndarray, norms: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) scores that distances between ``low`` and ``high`` allow, with slack for rounding."""
    both = (norms + longest)[:, None]
    slack = 1.0 + 1e-9 * both
    return (both - np.square(high)) / 2 - slack, (both - np.square(low)) / 2 + slack


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as int64: in doubles where all sums stay exact, else in Python's integers."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < float(1 << 53):
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return np.clip(whole(q) @ whole(x).T, LOWEST, HIGHEST).astype(np.int64)


class Search:
    """The ``k`` best rows in each window of the queries of one batch, block by block."""

    def __init__(self, names: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, longest: float):
        self.names, self.labels, self.q, self.low, self.high, self.same, self.k, self.longest = names, labels, q, low, high, same, k, longest
        self.norms = np.einsum("ij,ij->i", q, q)
        shape = (*low.shape, k)
        self.scores, self.ids, self.found = np.full(shape, LOWEST, np.int64), np.full(shape, HIGHEST, np.int64), np.zeros(shape, bool)

    def floor(self) -> np.ndarray:
        """The least score that can still enter each window."""
        return np.where(self.found[:, :, -1], np.maximum(self.low, self.scores[:, :, -1]), self.low)

    def _meets(self, who: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return ((most[:, None] >= self.floor()[who]) & (least[:, None] <= self.high[who])).any(1)

    def visit(self, tree: Tree, x: np.ndarray, names: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        d = {}
        low, high = [np.zeros(len(self.q))], [np.full(len(self.q), np.inf)]
        v = [n for n, at in enumerate(tree.vantage) if at >= 0]
        if v:
            both = (self.norms + self.longest)[:, None] - 2 * (self.q @ x[[tree.vantage[n] for n in v]].T)
            d = dict(zip(v, np.sqrt(np.maximum(both, 0.0)).T))
        for node in range(1, len(tree.parent)):
            up = tree.parent[node]
            low.append(np.maximum(low[up], np.maximum(d[up] - tree.high[node], tree.low[node] - d[up])))
            high.append(np.minimum(high[up], d[up] + tree.high[node]))
        leaves = [n for n, at in enumerate(tree.vantage) if at < 0]
        low, high = np.stack([low[n] for n in leaves], 1), np.stack([high[n] for n in leaves], 1)
        least, most = score_range(low, high, self.norms, self.longest)
        nearest = np.argsort(low, axis=1, kind="stable")
        everyone = np.arange(len(self.q))
        for turn in range(len(leaves)):
            leaf = nearest[:, turn]
            near = most[everyone, leaf]
            live = self._meets(everyone, least[everyone, leaf], near)
            if not live.any() and (near[:, None] < self.floor()).all():  # all later leaves are farther still
                return
            for n in np.unique(leaf[live]):
                first, end = tree.stretch[leaves[n]]
                rows = tree.rows[first:end]
                self._take(np.flatnonzero(live & (leaf == n)), x[rows], names[rows], ids[rows], labels[rows])

    def _take(self, who: np.ndarray, x: np.ndarray, names: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        scores = products(self.q[who], x)
        fits = ((labels[None] == self.labels[who][:, None]) == self.same) & (names[None] != self.names[who][:, None])
        floor = self.floor()
        for w in range(self.low.shape[1]):
            good = fits & (scores >= floor[who, w][:, None]) & (scores <= self.high[who, w][:, None])
            some = good.any(1)
            if some.any():
                at, good = who[some], good[some]
                s = np.concatenate([self.scores[at, w], np.where(good, scores[some], LOWEST)], 1)
                i = np.concatenate([self.ids[at, w], np.broadcast_to(ids, good.shape)], 1)
                f = np.concatenate([self.found[at, w], good], 1)
                i = np.where(f, i, HIGHEST)
                # ~s and not -s: the lowest integer has no opposite
                best = np.lexsort((i, ~s, ~f), axis=-1)[:, : self.k]
                self.scores[at, w], self.ids[at, w], self.found[at, w] = (np.take_along_axis(m, best, 1) for m in (s, i, f))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(ends)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat[ends[0] : ends[-1]]
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them all."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


class Index:
    """All rows in blocks, each a written vantage-point tree; ``rows`` has a name (hash of the whole row), id, label, vector and cell of each."""

    def __init__(self, rows: DataFrame, key: str, vector: str, label: str):
        spark = rows.sparkSession
        fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        ok = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
        ok = ok.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", fine))
        ok = ok.select("id", "label", F.transform("v", lambda x: F.floor(x * RASTER)).alias("v")).dropDuplicates()
        ok = stored(ok.withColumn("name", F.xxhash64("id", "label", "v")), "rows")
        squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        facts = ok.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("longest"), F.max(F.size("v")).alias("width")).first()
        self.n, self.longest, self.width = facts["n"], float(facts["longest"] or 0.0), int(facts["width"] or 0)
        sample = ok.select("v", F.xxhash64("name", F.lit("sample")).alias("h")).orderBy("h").limit(TOP_SAMPLE).toArrow() if self.n else None
        top = np.zeros((1, self.width)) if sample is None else _matrix(sample.column("v"), self.width)
        self.router = Router(top, self.longest, min(TOP_LEAVES, max(1, self.n // BLOCK)))
        router, width = spark.sparkContext.broadcast(self.router), self.width

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.append_column("cell", pa.array(router.value.cells(_matrix(batch.column("v"), width)), pa.int64()))

        labels = ok.schema["label"].dataType.simpleString()
        self.rows = stored(ok.mapInArrow(place, f"id long, label {labels}, v array<long>, name long, cell long"), "cells")
        sizes = {r["cell"]: r["count"] for r in self.rows.groupBy("cell").count().collect()}  # at most TOP_LEAVES
        self.parts = {c: -(-n // BLOCK) for c, n in sizes.items()}
        self.first, at = {}, 0
        for cell in sorted(self.parts):
            self.first[cell], at = at, at + self.parts[cell]
        table = spark.createDataFrame([(c, self.first[c], self.parts[c]) for c in self.parts] or [(-1, 0, 1)], "cell long, first long, parts long")
        dealt = self.rows.join(F.broadcast(table), "cell").withColumn("block", F.expr("first + pmod(xxhash64(id, name), parts)"))
        longest = self.longest

        def tree(group: pa.Table) -> pa.Table:
            x, cell = _matrix(group.column("v"), width), group.column("cell")[0].as_py()
            low, high = router.value.ranges(cell, x)
            # the same order whatever order the rows came in
            order = np.lexsort((group.column("name").to_numpy(), group.column("id").to_numpy()))
            columns = [group.column(c).to_numpy()[order] for c in ("name", "id", "label")]
            x = x[order]
            packed = pickle.dumps((build(x, longest, LEAF), _small(x), *columns), protocol=5)
            return pa.table({"block": [group.column("block")[0].as_py()], "cell": [cell], "low": pa.array([low], pa.list_(pa.float64())), "high": pa.array([high], pa.list_(pa.float64())), "packed": pa.array([packed], pa.binary())})

        built = dealt.select("id", "label", "v", "name", "cell", "block").groupBy("block").applyInArrow(tree, "block long, cell long, low array<double>, high array<double>, packed binary")
        self.blocks = stored(built, "blocks")
        ends = self.blocks.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("level", "d")).groupBy("cell", "level").agg(F.min("d.low").alias("a"), F.max("d.high").alias("b"))
        self.ranges: dict[int, tuple[list[float], list[float]]] = {c: ([0.0] * len(self.router.paths[c]), [np.inf] * len(self.router.paths[c])) for c in self.parts}
        for r in ends.collect():  # cells times levels
            self.ranges[r["cell"]][0][r["level"]], self.ranges[r["cell"]][1][r["level"]] = r["a"], r["b"]

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """Rows (name, window, rank, found, score): the k best rows of each window of ``anchors`` (name, label, v, cell, low, high as arrays of longs)."""
        spark = anchors.sparkSession
        router, ranges, longest, width = spark.sparkContext.broadcast(self.router), self.ranges, self.longest, self.width
        counts = {r["cell"]: r["count"] for r in anchors.groupBy("cell").count().collect()}
        spread, batch, room = [], 0, BATCH
        for cell in sorted(counts):  # near cells share a batch; a cell of many anchors has batches of its own
            parts = -(-counts[cell] // BATCH)
            if counts[cell] > room:
                batch, room = batch + 1, BATCH
            spread.append((cell, batch, parts))
            batch, room = (batch + parts, BATCH) if parts > 1 else (batch, room - counts[cell])
        table = spark.createDataFrame(spread or [(-1, 0, 1)], "cell long, first long, parts long")
        dealt = anchors.join(F.broadcast(table), "cell").withColumn("batch", F.expr("first + pmod(xxhash64(name), parts)"))
        blocks_of = {c: range(self.first[c], self.first[c] + self.parts[c]) for c in self.parts}

        def want(group: pa.Table) -> pa.Table:
            q = _matrix(group.column("v"), width)
            low, high = (np.array(group.column(c).to_pylist(), np.int64).reshape(len(q), -1) for c in ("low", "high"))
            near, far = router.value.bounds(q, ranges)
            least, most = score_range(near, far, np.einsum("ij,ij->i", q, q), longest)
            met = ((most[:, :, None] >= low[:, None, :]) & (least[:, :, None] <= high[:, None, :])).any((0, 2))
            order = np.where(met, near.min(0), np.inf)
            wanted = [(b, float(order[n])) for n, c in enumerate(sorted(ranges)) if met[n] for b in blocks_of[c]]
            packed = pickle.dumps((group.column("name").to_numpy(), group.column("label").to_numpy(), q, low, high), protocol=5)
            tiles = sorted({b // TILE for b, _ in wanted})
            n = len(tiles) + len(wanted)
            return pa.table({
                "batch": pa.array([group.column("batch")[0].as_py()] * n, pa.int64()), "tile": pa.array(tiles + [b // TILE for b, _ in wanted], pa.int64()),
                "block": pa.array([None] * len(tiles) + [b for b, _ in wanted], pa.int64()), "near": pa.array([-1.0] * len(tiles) + [d for _, d in wanted], pa.float64()),
                "asked": pa.array([packed] * len(tiles) + [None] * len(wanted), pa.binary()),
            })

        wants = stored(dealt.select("name", "label", "v", "low", "high", "batch").groupBy("batch").applyInArrow(want, "batch long, tile long, block long, near double, asked binary"), "wants")
        met = wants.where("block IS NOT NULL").join(self.blocks.select("block", "packed"), "block").select("batch", "tile", "near", "block", "packed")
        both = met.unionByName(wants.where("block IS NULL").select("batch", "tile", "near", "block", F.col("asked").alias("packed")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now: Search | None = None

            def results() -> pa.RecordBatch:
                at, w, rank = np.nonzero(now.found)
                columns = [now.names[at], w.astype(np.int32), now.ids[at, w, rank], now.scores[at, w, rank]]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "window", "found", "score"])

            for batch in batches:
                for block, packed in zip(batch.column(3).to_pylist(), batch.column(4)):
                    load = pickle.loads(packed.as_buffer())
                    if block is None:
                        if now is not None:
                            yield results()
                        now = Search(*load, same, k, longest)
                    else:
                        tree, x, *columns = load
                        now.visit(tree, x.astype(np.float64), *columns)
            if now is not None:
                yield results()

        order = ["batch", "tile", "near", "block"]
        found = both.repartition("batch", "tile").sortWithinPartitions(*order).mapInArrow(run, "name long, window int, found long, score long")
        best = Window.partitionBy("name", "window").orderBy(F.desc("score"), "found")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives: rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on ``id`` that says which rows ask. Positives are an anchor's best rows of its label; for each, the best
    rows of other labels whose score is between ``low`` and ``high`` percent of the positive's are returned.
    """
    index = Index(rows, key, vector, label)
    asking = index.rows.where(anchor)
    one = lambda v: F.array(F.lit(v).cast("long"))
    near = stored(index.search(asking.select("name", "label", "v", "cell", one(LOWEST).alias("low"), one(HIGHEST).alias("high")), True, positives), "positives")
    # windows of an anchor by the rank of its positive; those of missing positives are empty
    windows = near.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("of"))  # at most ``positives`` of a name
    share = lambda round_, r, percent: F.expr(f"cast({round_}(cast(try_element_at(of, {r}) AS decimal(20, 0)) * {percent} / 100) AS long)")
    ranks = range(1, positives + 1)
    asked = asking.join(windows, "name").select(
        "name", "label", "v", "cell", F.array(*[F.coalesce(share("ceil", r, low), F.lit(HIGHEST)) for r in ranks]).alias("low"), F.array(*[F.coalesce(share("floor", r, high), F.lit(LOWEST)) for r in ranks]).alias("high")
    )
    hard = index.search(asked, False, negatives).select("name", (F.col("window") + 1).alias("place"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    good = near.select("name", F.col("rank").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asking.select("name", F.col("id").alias("anchor_id"))
    return good.join(hard, ["name", "place"]).join(names, "name").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.select("vec_id", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"), "embedding")
    return mine(moved, F.col("id") % 50 == 0)
