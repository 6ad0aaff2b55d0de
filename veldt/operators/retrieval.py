"""Hybrid retrieval: dense ranks, rank fusion, admission, reranking, delivery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators.shared import LARGE_ROWS, written

RRF = 60
BLOCK = 4096
#: Pairs whose counts a task holds before it lets them out.
HELD_ROWS = 4_000_000


def _blocks(df: DataFrame, key: str, vector: str, name: str, rows: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (name, dim, ids, data): vectors of one length packed by a hash of their key, about ``rows`` in each, with further columns ``more``."""
    n = max(1, -(-df.count() // rows))
    block = F.pmod(F.xxhash64(key), F.lit(n))
    picked = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), block.alias("b"), *more)
    packed = picked.groupBy(F.size("v").alias("dim"), "b").agg(F.collect_list(F.struct("id", "v", *more)).alias("rows"))
    return packed.select(F.col("b").alias(name), "dim", F.col("rows.id").alias(f"{name}_ids"), F.col("rows.v").alias(f"{name}_data"), *[F.col(f"rows.{x}").alias(x) for x in more])


def _block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each query block beside each corpus block, both written tables; their vectors may differ in length.

    Blocks meet where they are read. Neither side is broadcast or repeated for the other, which would grow with the product of both.
    """
    return right.drop("c", "dim").crossJoin(left.drop("q", "dim").hint("shuffle_replicate_nl"))


def _each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """The lists of each row by name."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].values for k, name in enumerate(batch.schema.names)}


def _units(pair: dict[str, pa.Array], side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which vectors of a block have a direction, their ids, their unit vectors)."""
    ids, data = pair[f"{side}_ids"], pair[f"{side}_data"]
    v = data.flatten().to_numpy(zero_copy_only=False)
    v = v.reshape(len(data), len(v) // max(len(data), 1))
    norms = np.linalg.norm(v, axis=1)
    ok = norms > 0
    return ok, ids.to_numpy(zero_copy_only=False).astype(np.int64)[ok], v[ok] / norms[ok, None]


def dense_topk(corpus: DataFrame, queries: DataFrame, key: str, query: str, vector: str, k: int, exclude_self: bool = False) -> DataFrame:
    """Rows (query, key, cosine, rank): exactly the ``k`` rows nearest to each query by cosine, ties by key.

    Vectors are packed into blocks; each pair of a query block and a corpus block is one matrix product, of which the best
    ``k`` a query leave the task. Zero vectors are skipped. Keys are longs.
    """
    left = written(_blocks(queries, query, vector, "q", 512), "blocks", LARGE_ROWS)
    right = written(_blocks(corpus, key, vector, "c", BLOCK), "blocks", LARGE_ROWS)
    pairs = _block_pairs(left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _each_pair(batches):
            (_, qi, q), (_, ci, c) = _units(pair, "q"), _units(pair, "c")
            if not len(q) or not len(c) or q.shape[1] != c.shape[1]:
                continue
            s = np.round(q @ c.T, 9)
            if exclude_self:
                s[qi[:, None] == ci[None, :]] = -2
            # all that tie with the k-th are kept here; the rank decides
            kth = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
            i, j = np.nonzero((s >= kth[:, None]) & (s > -2))
            yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(ci[j]), pa.array(s[i, j])], ["q", "c", "cosine"])

    best = pairs.select("q_ids", "q_data", "c_ids", "c_data").mapInArrow(run, "q long, c long, cosine double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("cosine").desc(), F.col("c")))
    out = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("q").alias(query), F.col("c").alias(key), "cosine", "rank")


def dense_ranks(corpus: DataFrame, queries: DataFrame, picked: DataFrame, key: str, query: str, vector: str) -> DataFrame:
    """Rows (query, key, rank): the rank by cosine among all of ``corpus`` that each pair (query, key) of ``picked`` has.

    Order and rounding are those of ``dense_topk``; a pair without two vectors that compare has no row. A query has a page of
    pairs. Their cosines are taken from the matrix products of all blocks; then each block counts how many of its rows go before each pair,
    and a task lets out the counts of all its blocks together.
    """
    right = written(_blocks(corpus, key, vector, "c", BLOCK), "blocks", LARGE_ROWS)
    pair = picked.select(F.col(query).alias("__q"), F.col(key).alias("c")).where("__q IS NOT NULL AND c IS NOT NULL").distinct()

    def products(wanted: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        lists = wanted.groupBy("__q").agg(F.collect_list(F.struct(*columns)).alias("w")).select("__q", *[F.col(f"w.{x}").alias(f"w_{x}") for x in columns])
        more = tuple(f"w_{x}" for x in columns)
        left = _blocks(queries.join(lists, F.col(query) == F.col("__q")), query, vector, "q", 512, more)
        return _block_pairs(written(left, "blocks", LARGE_ROWS), right).select("q_ids", "q_data", "c_ids", "c_data", *more)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for pair in _each_pair(batches):
            (ok, qi, q), (_, ci, c) = _units(pair, "q"), _units(pair, "c")
            if not len(q) or not len(c) or q.shape[1] != c.shape[1]:
                continue
            lists = [pair[x].take(pa.array(np.flatnonzero(ok))) for x in pair if x.startswith("w_")]
            ends = np.append(0, np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False)))
            yield qi, ci, np.round(q @ c.T, 9), ends, *[x.flatten().to_numpy(zero_copy_only=False) for x in lists]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qi, ci, s, ends, keys in each(batches):
            order = np.argsort(ci, kind="stable")
            first, last = (np.searchsorted(ci[order], keys, side) for side in ("left", "right"))
            some, n = np.flatnonzero(last > first), (last - first)[last > first]
            at = order[np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            row = np.repeat(np.repeat(np.arange(len(qi)), np.diff(ends))[some], n)
            yield pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(ci[at]), pa.array(s[row, at])], ["__q", "c", "cosine"])

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for first in range(0, len(held), 1024):
                some = list(held.items())[first : first + 1024]
                q = np.repeat([q for q, _ in some], [len(c) for _, (c, _) in some])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, *[np.concatenate([pair[i] for _, pair in some]) for i in (0, 1)])], ["q", "c", "n"])

        for qi, ci, s, ends, keys, cosines in each(batches):
            for q, row, a, b in zip(qi.tolist(), s, ends, ends[1:]):
                key, cosine = keys[a:b], cosines[a:b]
                low = np.sort(-row)
                n, upto = (np.searchsorted(low, -cosine, side).astype(np.int64) for side in ("left", "right"))
                for i in np.flatnonzero(upto > n):  # of equal cosines the smaller keys
                    n[i] += np.count_nonzero(ci[row == cosine[i]] < key[i])
                if q in held:
                    held[q][1][:] += n
                    continue
                held[q], rows = (key.copy(), n), rows + len(key)
                if rows > HELD_ROWS:
                    yield from out()
                    held, rows = {}, 0
        yield from out()

    # counted against cosines of one computation, so that the written table decides and not a second run
    scored = written(products(pair, ("c",)).mapInArrow(own, "__q long, c long, cosine double"), "scored")
    counted = products(scored, ("c", "cosine")).mapInArrow(before, "q long, c long, n long").groupBy("q", "c").agg((F.sum("n") + 1).alias("rank"))
    return counted.select(F.col("q").alias(query), F.col("c").alias(key), "rank")


def terms(text: Column) -> Column:
    """Words of a text: runs of letters a-z and digits after lower-casing; everything else separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"))


def fuse(dense: DataFrame, lexical: DataFrame, query: str, key: str, k: int, constant: int = RRF) -> DataFrame:
    """Rows (query, key, dense_rank, lexical_rank, score, rank): reciprocal ranks added up in exact decimals, ties by key.

    A row that only one side ranks counts with that side; a query without a vector has lexical ranks only.
    """
    d = dense.select(query, key, F.col("rank").alias("dense_rank"))
    x = lexical.select(query, key, F.col("rank").alias("lexical_rank"))
    one = lambda c: F.coalesce(F.lit(1).cast("decimal(38,20)") / (F.col(c) + constant), F.lit(0).cast("decimal(38,20)"))
    both = d.join(x, [query, key], "full_outer").withColumn("score", (one("dense_rank") + one("lexical_rank")).cast("decimal(38,15)"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(key)))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse_whole(dense: DataFrame, lexical, corpus: DataFrame, queries: DataFrame, query: str, key: str, vector: str, k: int, depth: int) -> DataFrame:
    """``fuse`` over the whole ranks of both sides; ``dense`` is ``dense_topk`` of ``depth`` rows and ``lexical`` a ``lexical.LexicalSearch``.

    The best ``depth`` of each side only name the rows to fuse; each enters with its rank among all on both sides. With
    2 / (RRF + depth + 1) < 1 / (RRF + k) no row beyond them on both sides is among the ``k`` best, as a side that has
    more than ``depth`` rows has ``k`` of at least 1 / (RRF + k).
    """
    if 2 * (RRF + k) >= RRF + depth + 1:
        raise ValueError("depth too small for k")
    picked = written(dense.select(query, key).unionByName(lexical.topk(depth).select(query, key)).distinct(), "picked")
    return fuse(dense_ranks(corpus, queries, picked, key, query, vector), lexical.ranks(picked), query, key, k)


def missing_fields(required: Column, observed: list[str], order: list[str]) -> Column:
    """Required fields that were not observed, in the order of ``order``; an empty requirement misses nothing."""
    return F.filter(F.array(*[F.lit(f) for f in order]), lambda f: F.array_contains(required, f) & ~f.isin(observed))


def gate(df: DataFrame, required: str, observed: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``missing`` and ``admissible``: a row is admitted if everything it requires was observed.

    A required field outside ``order`` is unknown and raises when the result is computed.
    """
    req = F.coalesce(F.col(required), F.array().cast("array<string>"))
    unknown = F.array_except(req, F.array(*[F.lit(f) for f in order]))
    missing = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown field "), unknown[0])).cast("array<string>")).otherwise(missing_fields(req, observed, order))
    return df.withColumn("missing", missing).withColumn("admissible", F.size("missing") == 0)


def refusals(gated: DataFrame) -> DataFrame:
    """Rows (field, n_blocked, n_unlocked): how many rows each missing field blocks, and how many it blocks alone."""
    each = gated.where(~F.col("admissible")).select(F.explode("missing").alias("field"), (F.size("missing") == 1).alias("alone"))
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("n_blocked"), F.count_if("alone").cast("long").alias("n_unlocked"))


def next_best(refused: DataFrame) -> DataFrame:
    """The field whose recording would admit most rows; ties go to the first name."""
    return refused.orderBy(F.col("n_unlocked").desc(), F.col("n_blocked").desc(), "field").limit(1)


def rerank(ranked: DataFrame, scores: DataFrame, query: str, key: str, rank: str = "rank") -> DataFrame:
    """``ranked`` with ``score`` and ``final_rank``: by score if every row of the query has one, else as it was.

    Equal scores keep their order. ``scores`` has (key, score) and isn't broadcast, as a small file may hold very many.
    """
    joined = ranked.join(scores.select(F.col(key).alias("__key"), F.col("score").alias("rerank_score")).hint("merge"), F.col(key) == F.col("__key"), "left").drop("__key")
    whole = Window.partitionBy(query)
    joined = joined.withColumn("reranked", F.count_if(F.col("rerank_score").isNull()).over(whole) == 0)
    by = F.when(F.col("reranked"), -F.col("rerank_score")).otherwise(F.lit(0.0))
    return joined.withColumn("final_rank", F.row_number().over(whole.orderBy(by, rank)))


def unstable_pairs(runs: DataFrame, query: str, key: str, a: str, b: str, gap: float) -> DataFrame:
    """Rows (query, n_swapped): pairs of rows of a query that two score columns order differently although ``a`` has them more than ``gap`` apart.

    A query has the rows of one result page, so pairs are within a bounded set.
    """
    x = runs.select(F.col(query).alias("q"), F.col(key).alias("k1"), F.col(a).alias("a1"), F.col(b).alias("b1"))
    y = runs.select(F.col(query).alias("q"), F.col(key).alias("k2"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    pairs = x.join(y, "q").where((F.col("a1") - F.col("a2") > gap) & (F.col("b1") < F.col("b2")))
    return pairs.groupBy(F.col("q").alias(query)).agg(F.count(F.lit(1)).alias("n_swapped"))


def deliver(df: DataFrame, group: list[str], item: str, section: str, sections: list[str], rank: str, most: int) -> DataFrame:
    """Rows with ``tag`` S1..Sn of each group: items once, at their best rank, by section order and rank, ``most`` a section."""
    once = df.groupBy(*group, item).agg(F.min_by(F.struct(section, rank), F.col(rank)).alias("b")).select(*group, item, F.col(f"b.{section}").alias(section), F.col(f"b.{rank}").alias(rank))
    place = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col(section))
    inside = F.row_number().over(Window.partitionBy(*group, section).orderBy(rank, item))
    short = once.withColumn("__place", place).where(F.col("__place") > 0).withColumn("__in", inside).where(F.col("__in") <= most)
    number = F.row_number().over(Window.partitionBy(*group).orderBy("__place", "__in"))
    return short.withColumn("tag", F.concat(F.lit("S"), number)).drop("__place", "__in")


def replay_status(requests: DataFrame, known: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """``requests`` with ``status``: new, replay (same key and fingerprint) or conflict (same key, other fingerprint)."""
    side = known.select(F.col(key).alias("__key"), F.col(fingerprint).alias("__fp"))
    joined = requests.join(side, requests[key] == side["__key"], "left")
    status = F.when(F.col("__key").isNull(), "new").when(F.col("__fp").eqNullSafe(F.col(fingerprint)), "replay").otherwise("conflict")
    return joined.select(*requests.columns, status.alias("status"))
