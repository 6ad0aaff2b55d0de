"""Data preparation: connected components, whole-group splits, folds, leakage checks, near-duplicate clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators.ordering import running_totals
from veldt.operators.shared import written


#: Rows of small groups that one call of Python gets together.
SLOT_ROWS = 4096


#: Shingles are counted in so many bins, a power of two.
BINS = 1 << 16


#: A list of fewer sets is broadcast to where the sets are.
ASKED = 1_000_000


#: A key of so many rows is hot. Its rows are met by a broadcast list, which so has fewer keys than the rows divided by this.
HOT_ROWS = 100_000


def spread_join(left: DataFrame, right: DataFrame, on: str, met: str) -> DataFrame:
    """``left`` joined with ``right``, a written table with one row for each ``on`` and in ``met`` how many rows of the left have it.

    Rows of hot keys stay where they are, so that no task gets all rows of a key.
    """
    hot = right.where(F.col(met) >= HOT_ROWS).drop(met)
    cold = right.where(F.col(met) < HOT_ROWS).drop(met)
    if hot.isEmpty():
        return left.join(cold, on)
    hot = F.broadcast(hot)  # few keys of many rows
    return left.join(hot, on).unionByName(left.join(hot.select(on), on, "left_anti").join(cold, on))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): the smallest node that each node of an edge list reaches. Keys are longs.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its smallest neighbour,
    then its smaller ones. Rounds grow with the logarithm of the size, and a round is a window-free aggregation and a join. The rows of a hub, as
    the smallest node of a large component becomes one, are combined before they are shuffled and are never gathered in a task.
    """
    both = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    while True:
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = sides.where("v > u")
        least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("met")).where("met > 0").withColumn("m", F.least("u", "m"))
        large = spread_join(up, written(least, "least"), "u", "met").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        lows = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("met"))
        small = spread_join(large, written(lows, "lows"), "u", "met").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small, "star")
        change = after.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(after, ["u", "v"], "left_anti").isEmpty()
        now = after
        if change:
            break
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def group_split(df: DataFrame, group: str, stratum: str, share: float, seed: int) -> DataFrame:
    """``df`` with ``held``: whole groups are held out, about ``share`` of the rows of each stratum.

    Groups go in the order of a hash. A group is held out if the rows of all groups before it and half of its own are within the
    stratum's quota, which is the nearest whole number to its share. A group's stratum is its smallest. Sums run in slices, so
    a stratum of any size is spread over tasks.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.min(stratum).alias("__stratum"))
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
    ordered = running_totals(sizes.withColumn("__mark", mark), ["__stratum"], "__mark", F.col("__n"), "__upto")
    quotas = sizes.groupBy("__stratum").agg(F.round(F.sum("__n") * share).alias("__quota")).withColumnRenamed("__stratum", "__s")
    judged = ordered.join(quotas, F.col("__stratum").eqNullSafe(F.col("__s")))
    judged = judged.select(F.col(group).alias("__group"), (F.col("__upto") - F.col("__n") / 2 <= F.col("__quota")).alias("held"))
    return df.join(judged, df[group].eqNullSafe(F.col("__group"))).drop("__group")


def folds(df: DataFrame, key: str, stratum: str, k: int, seed: int) -> DataFrame:
    """``df`` with ``fold`` 0 to k - 1: rows of each stratum in the order of a hash are dealt in turn."""
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
    ordered = running_totals(df.withColumn("__mark", mark), [stratum], "__mark", F.lit(1), "__rn")
    return ordered.withColumn("fold", ((F.col("__rn") - 1) % k).cast("long")).drop("__mark", "__rn")


def leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Rows (group, n_splits): groups that are in more than one split. A clean split has none."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def suppress(df: DataFrame, group: str, start: str, end: str, score: str, key: str) -> DataFrame:
    """Rows of ``df`` that stay if, best score first, rows that overlap one that stays are dropped (within a group).

    Overlaps chain only inside runs of touching intervals; those runs are found by a window and each is decided alone.
    """
    import pandas as pd

    w = Window.partitionBy(group).orderBy(start, key)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0))
    runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    slots = max(1, -(-df.count() // SLOT_ROWS))
    runs = runs.withColumn("__slot", F.pmod(F.xxhash64(group, "__run"), F.lit(slots)))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True])
        kept: list[int] = []
        taken: dict[tuple, list[tuple]] = {}
        for i, row in enumerate(zip(pdf[group], pdf["__run"], pdf[start], pdf[end])):
            own = taken.setdefault(row[:2], [])
            if all(row[3] <= a or row[2] >= b for a, b in own):
                kept.append(i)
                own.append(row[2:])
        return pdf.iloc[kept].drop(columns=["__run", "__slot"])

    return runs.groupBy("__slot").applyInPandas(greedy, df.schema)


def shingles(df: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """Rows (key, tokens): the distinct hashed word runs of each text; texts with fewer words have one."""
    split = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    # as a variable of a lambda the words are split once and not for each run
    runs = F.transform(
        F.array(split),
        lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(words - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " "))),
    )
    return df.select(F.col(key).alias("key"), F.array_distinct(runs[0]).alias("tokens"))


def near_duplicates(df: DataFrame, key: str, text: str, least: float = 0.8, words: int = 5) -> DataFrame:
    """Rows (key, cluster): texts whose word shingles have a Jaccard similarity of ``least`` or more are linked, links chain.

    Exact search by prefixes: with shingles in one order for all sets, two sets this similar share some of the first few, their heads, so only those meet
    that share enough; sizes must fit too. The order goes by how many shingles share a shingle's bin, so that frequent ones come late. Heads are
    shuffled; whole sets stay in their file and only those of pairs that share enough heads leave it.
    Equal sets collapse to one row before. At first each set of a shingle meets the first one there; then all meet that these links leave in different
    clusters, so a family of similar sets makes no pairs of all its members.
    """
    sets = written(shingles(df, key, text, words).withColumn("shape", F.xxhash64(F.array_sort("tokens"))), "shingles")
    distinct = written(_heads(sets, least).groupBy("shape").agg(F.min("key").alias("rep"), F.first("heads").alias("heads"), F.first("n").alias("n")), "heads")
    heads = distinct.select(F.explode("heads").alias("token"), "rep", "n")
    near = F.least("na", "nb") >= F.greatest("na", "nb") * least
    enough = F.col("heads") >= _shared_heads(F.col("na"), F.col("nb"), least)
    first = heads.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("f"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    shared = written(heads.join(first, "token"), "shared")
    met = shared.select(F.col("f.rep").alias("a"), F.col("f.n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb")).where(F.col("a") < F.col("b")).where(near)
    # pairs that share more heads, but under other first sets, meet below
    pairs = written(met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("heads")).where(enough).select("a", "b").distinct(), "pairs")
    links = written(_similar(pairs, sets, distinct, least), "links")
    found = components(links, "a", "b").withColumnRenamed("node", "rep")
    parts = shared.select("token", "rep", "n").join(found, "rep", "left").select("token", "rep", "n", F.coalesce("component", "rep").alias("part"))
    open_ = parts.groupBy("token").agg((F.min("part") < F.max("part")).alias("open")).where("open").select("token")
    parts = written(parts.join(open_, "token", "left_semi"), "parts")
    side = lambda x: parts.select("token", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("part").alias(f"p{x}"))
    across = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & near)
    across = across.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("heads")).where(enough).select("a", "b").distinct()
    more = written(_similar(written(across.join(pairs, ["a", "b"], "left_anti"), "pairs"), sets, distinct, least), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more), "a", "b").withColumnRenamed("node", "rep")
    named = distinct.select("shape", "rep").join(found, "rep", "left").select("shape", F.coalesce("component", "rep").alias("cluster"))
    return sets.select("key", "shape").join(named, "shape").select(F.col("key").alias(key), "cluster")


def _shared_heads(na: Column, nb: Column, least: float) -> Column:
    """So many heads at least two sets of ``na`` and ``nb`` shingles share that are similar enough.

    Of the set whose last head comes first, all heads that the other has are heads of the other too, and the shingles that both have and that are no heads of it
    are at most those beyond its heads.
    """
    both = F.ceil((na + nb) * least / (1 + least) - 1e-6)
    return F.greatest(F.lit(1), both + F.lit(1) - F.greatest(F.ceil(na * least), F.ceil(nb * least)))


def _heads(sets: DataFrame, least: float) -> DataFrame:
    """Rows (shape, key, heads, n): the first shingles of each set of n by which it meets all sets that are similar enough."""
    bins = sets.select(F.explode("tokens").alias("token")).groupBy(F.col("token").bitwiseAND(BINS - 1).alias("bin")).count()
    counts = np.zeros(BINS, np.int64)
    for row in bins.collect():  # BINS numbers
        counts[row["bin"]] = row["count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            token, row = batch.column(2).flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((token, counts[token & (BINS - 1)], row))
            place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            most = sizes - np.ceil(sizes * least).astype(np.int64) + 1
            some = place < np.repeat(most, sizes)
            heads = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(most, sizes))), pa.int32()), pa.array(token[order][some]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), heads, pa.array(sizes, pa.int32())], ["shape", "key", "heads", "n"])

    return sets.select("shape", "key", "tokens").mapInArrow(run, f"shape long, key {sets.schema['key'].dataType.simpleString()}, heads array<long>, n int")


def _similar(pairs: DataFrame, sets: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b), a written table, of sets whose Jaccard similarity is ``least`` or more. Only the sets of pairs are shuffled."""
    asked = written(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct().join(distinct.select("rep", F.col("shape").alias("__shape")), "rep"), "asked")
    if asked.count() < ASKED:
        asked = F.broadcast(asked)
    needed = sets.join(asked, (F.col("key") == F.col("rep")) & (F.col("shape") == F.col("__shape"))).select("rep", "tokens")
    left = needed.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    right = needed.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(common >= (F.size("ta") + F.size("tb") - common) * least).select("a", "b").distinct()
