"""Suppression of boxes by overlap: best scores first, a box goes if it overlaps one that stays by more than a share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators import scan
from veldt.operators.shared import written

#: A group of up to so many boxes is decided in its task, larger ones in rounds over grids; a task's call gets about SLOT_ROWS boxes of many groups.
LOCAL_ROWS, SLOT_ROWS = 4096, 32_768

#: Of each cell so many of the best boxes are looked at in a round.
TOP = 16


def overlap_share(p: Column, q: Column) -> Column:
    """Intersection over union of two boxes given as structs of l, t, r and b; 0 without area."""
    width = F.least(p["r"], q["r"]) - F.greatest(p["l"], q["l"])
    height = F.least(p["b"], q["b"]) - F.greatest(p["t"], q["t"])
    common = F.when((width > 0) & (height > 0), width * height).otherwise(0.0)
    area = lambda x: (x["r"] - x["l"]) * (x["b"] - x["t"])
    union = area(p) + area(q) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def suppress_boxes(df: DataFrame, group: str, box: tuple[str, str, str, str], score: str, key: str, most: float = 0.5) -> DataFrame:
    """Rows of ``df`` that stay: in a group, best score first and ties by key, a box goes if its overlap with one that stays is above ``most``.

    ``box`` names left, top, right and bottom. Groups of up to LOCAL_ROWS boxes are decided where they are gathered, and groups above it in rounds
    that never gather one. There, boxes that overlap by a share have widths and heights that differ by no more than it, so each
    box stands in grids as wide and high as itself and a few steps coarser, and two such boxes meet in a cell. In rounds, a box among the TOP
    best of all its cells stays if none of the better ones there overlaps it too much, and what it so overlaps goes. A box meets at most TOP others of a
    cell in a round, so a round is linear in the boxes that are left, however many lie on one spot. Boxes without area, and with a null or
    non-finite edge, overlap nothing and stay. A null score is the worst; rows that are equal in all of these count in an order of their own.
    """
    if not 0 < most < 1:
        raise ValueError("the share lies between 0 and 1")
    edges = [F.col(c).cast("double").alias(n) for c, n in zip(box, "ltrb")]
    rows = written(df.withColumn("__id", F.monotonically_increasing_id()), "boxes")
    named = rows.select("__id", F.col(group).alias("g"), F.struct(*edges).alias("box"), F.struct((-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))).alias("s"), F.col(key).alias("k"), "__id").alias("place"))
    width, height = F.col("box.r") - F.col("box.l"), F.col("box.b") - F.col("box.t")
    fine = (width > 0) & (height > 0) & (width < float("inf")) & (height < float("inf"))
    solid = named.where(fine)
    hot = written(solid.groupBy("g").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > LOCAL_ROWS).select("g"), "hot")
    kept = _in_groups(scan.meet(solid, hot, ["g"], "left_anti"), most)
    if not hot.isEmpty():
        kept = kept.unionByName(_in_rounds(scan.meet(solid, hot, ["g"], "left_semi"), most))
    free = named.where(~F.coalesce(fine, F.lit(False))).select("__id")
    return rows.join(kept.unionByName(free), "__id", "left_semi").drop("__id")


def _in_groups(named: DataFrame, most: float) -> DataFrame:
    """The ``__id`` of boxes (__id, g, box, place) that stay; the groups of a slot are decided side by side."""
    slots = F.pmod(F.xxhash64("g"), F.lit(max(1, named.count() // SLOT_ROWS)))
    whole = Window.partitionBy("slot")
    placed = named.withColumn("slot", slots).withColumn("n", F.row_number().over(whole.orderBy("g", "place"))).withColumn("g", F.dense_rank().over(whole.orderBy("g")))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("n").to_numpy())
        group, left, top, right, bottom = (table.column(c).to_numpy()[order] for c in "gltrb")
        area, alive, stay = (right - left) * (bottom - top), np.arange(len(order)), []
        while len(alive):
            # the best box that is left of each group stays, and what it overlaps too much goes with it
            first = np.diff(group[alive], prepend=-1) != 0
            p, q = alive[first][np.cumsum(first) - 1], alive
            stay.append(alive[first])
            width = np.minimum(right[p], right[q]) - np.maximum(left[p], left[q])
            height = np.minimum(bottom[p], bottom[q]) - np.maximum(top[p], top[q])
            common = np.where((width > 0) & (height > 0), width * height, 0.0)
            union = area[p] + area[q] - common
            share = np.divide(common, union, out=np.zeros(len(q)), where=union > 0)
            alive = alive[~first & ~(share > most)]
        return pa.table({"__id": table.column("__id").take(pa.array(order[np.concatenate(stay)]))})

    return placed.select("slot", "g", "n", "__id", "box.*").groupBy("slot").applyInArrow(run, "__id long")


def _in_rounds(named: DataFrame, most: float) -> DataFrame:
    """The ``__id`` of boxes that stay, in rounds over the cells of grids."""
    width, height = F.col("box.r") - F.col("box.l"), F.col("box.b") - F.col("box.t")
    steps = F.sequence(F.lit(0), F.lit(math.ceil(-math.log2(most))))
    level = lambda size: F.floor(F.log2(size)).cast("int")
    cells = named.withColumn("x", F.explode(F.transform(steps, lambda d: level(width) + d))).withColumn("y", F.explode(F.transform(steps, lambda d: level(height) + d)))
    spread = lambda low, high, at: F.sequence(F.floor(F.col(low) / F.pow(F.lit(2.0), at)), F.floor(F.col(high) / F.pow(F.lit(2.0), at)))
    cells = cells.withColumn("i", F.explode(spread("box.l", "box.r", F.col("x")))).withColumn("j", F.explode(spread("box.t", "box.b", F.col("y"))))
    left = written(cells.select("__id", F.xxhash64("g", "x", "y", "i", "j").alias("cell"), "g", "box", "place"), "cells")
    kept = None
    while not left.isEmpty():
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("place"))
        ranked = left.withColumn("n", rank).where(F.col("n") <= TOP)
        best = written(ranked.groupBy("cell").agg(F.collect_list(F.struct("g", "box", "place")).alias("top"), F.max("place").alias("last")), "best")
        # equal hashes of different cells only make more boxes wait for one another
        seen = (F.col("place") <= F.col("last")) | (F.size("top") < TOP)
        blocked = F.exists("top", lambda x: (x["place"] < F.col("place")) & x["g"].eqNullSafe(F.col("g")) & (overlap_share(x["box"], F.col("box")) > most))
        judged = left.join(best, "cell").groupBy("__id").agg(F.min(seen & ~blocked).alias("stays"))
        stays = written(judged.where("stays").select("__id"), "stays")
        tops = left.join(stays, "__id", "left_semi").groupBy("cell").agg(F.collect_list(F.struct("__id", "g", "box")).alias("top"))  # at most TOP of a cell
        over = F.exists("top", lambda x: (x["__id"] != F.col("__id")) & x["g"].eqNullSafe(F.col("g")) & (overlap_share(x["box"], F.col("box")) > most))
        gone = left.join(tops, "cell").where(over).select("__id").distinct()
        out = written(gone.unionByName(stays), "out")
        kept = stays if kept is None else kept.unionByName(stays)
        left = written(left.join(out, "__id", "left_anti"), "cells")
    return kept if kept is not None else named.select("__id").limit(0)
