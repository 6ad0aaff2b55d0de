"""Scans along the rows of a key in an order, without putting a key of many rows into one task.

Keys of more than HOT_ROWS rows are cut into slices of the order by their own approximate quantiles; rows of equal order share a slice. Slices run
apart, each is summed up in one row, and what a slice needs from those before it is scanned over these few rows and joined
back by key and slice. Other keys have one slice and a plain window. Results don't depend on where the cuts lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators.shared import written

HOT_ROWS, MOST_SLICES = 100_000, 4_096
#: Numbers in a table that is broadcast at most.
BROADCAST = 2_000_000


def meet(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """Join on ``keys`` where nulls equal nulls; the keys of ``side`` don't come along."""
    named = side.select(*[F.col(k).alias(f"__side_{n}") for n, k in enumerate(keys)], *[c for c in side.columns if c not in keys])
    match = F.lit(True)
    for n, k in enumerate(keys):
        match &= F.col(f"`{k}`").eqNullSafe(F.col(f"__side_{n}"))
    return rows.join(F.broadcast(named) if small else named, match, how).drop(*[f"__side_{n}" for n in range(len(keys))])


def cut(df: DataFrame, keys: list[str], order: str, hot_rows: int | None = None) -> tuple[DataFrame, bool]:
    """(``df`` with ``__slice``, whether any key has more than one): slices follow one another in the numeric ``order``, nulls first."""
    most = hot_rows or HOT_ROWS
    counts = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most), "hot")
    facts = counts.agg(F.count(F.lit(1)).alias("keys"), F.max("__n").alias("n")).first()
    if not facts["keys"]:
        return df.withColumn("__slice", F.lit(0)), False
    slices = min(MOST_SLICES, -(-facts["n"] // most))
    small = facts["keys"] * slices < BROADCAST
    hot = meet(df, counts.drop("__n"), keys, "left_semi", small)
    share = [k / slices for k in range(1, slices)] or [0.5]
    ends = written(hot.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(F.col(order).cast("double"), share, 10 * slices)).alias("__ends")), "ends")
    told = meet(df, ends, keys, "left", small)
    return told.withColumn("__slice", F.coalesce(F.size(F.filter("__ends", lambda b: b < F.col(order))), F.lit(0))).withColumn("__slice", F.greatest("__slice", F.lit(0))).drop("__ends"), True


def _carried(rows: DataFrame, keys: list[str], sums: list[Column], over: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns ``over``: aggregates over the sums of all earlier slices of the key."""
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*keys, "__slice").agg(*sums)
    carry = per.select(*keys, "__slice", *[c.over(before).alias(name) for name, c in over.items()]).where("__slice > 0")
    return meet(rows, written(carry, "carry"), [*keys, "__slice"])


KINDS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def _merged(kind: str, a: Column, b: Column) -> Column:
    if kind in ("min", "max"):
        return (F.least if kind == "min" else F.greatest)(a, b)  # both pass over nulls
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def totals(df: DataFrame, keys: list[str], order: str, measures: dict[str, tuple[str, Column]], strictly: bool = False, hot_rows: int | None = None) -> DataFrame:
    """``df`` with ``measures`` ((count, sum, min or max), column) over the rows of its keys up to its own ``order``, equal ones included or, ``strictly``, not.

    ``order`` is a whole number. Without a row a count is 0 and the others are null.
    """
    rows, split = cut(df, keys, order, hot_rows)
    frame = Window.partitionBy(*keys, "__slice").orderBy(F.asc_nulls_first(order)).rangeBetween(Window.unboundedPreceding, -1 if strictly else 0)
    if not split:
        return rows.select(*df.columns, *[KINDS[kind](c).over(frame).alias(name) for name, (kind, c) in measures.items()])
    sums = [KINDS[kind](c).alias(f"__{name}") for name, (kind, c) in measures.items()]
    over = {f"__b_{name}": (F.sum if kind == "count" else KINDS[kind])(f"__{name}") for name, (kind, _) in measures.items()}
    own = rows.select("*", *[KINDS[kind](c).over(frame).alias(f"__o_{name}") for name, (kind, c) in measures.items()])
    joined = _carried(own, keys, sums, over)
    return joined.select(*df.columns, *[_merged(kind, F.col(f"__o_{name}"), F.col(f"__b_{name}")).alias(name) for name, (kind, _) in measures.items()])


def last_known(df: DataFrame, keys: list[str], order: str, tie: str, value: Column, name: str, before: bool = False, hot_rows: int | None = None) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` of its keys by (``order``, ``tie``), up to its own row or, with ``before``, to the one before it.

    ``order`` is numeric and ``tie`` parts rows of equal order.
    """
    rows, split = cut(df.withColumn("__value", value), keys, order, hot_rows)
    end = -1 if before else 0
    frame = Window.partitionBy(*keys, "__slice").orderBy(F.asc_nulls_first(order), F.asc_nulls_first(tie)).rowsBetween(Window.unboundedPreceding, end)
    own = rows.withColumn("__own", F.last("__value", ignorenulls=True).over(frame))
    if not split:
        return own.select(*df.columns, F.col("__own").alias(name))
    place = F.struct(F.col(order).isNotNull().alias("a"), F.col(order).alias("b"), F.col(tie).isNotNull().alias("c"), F.col(tie).alias("d"))
    last = F.max_by("__value", F.when(F.col("__value").isNotNull(), place)).alias("__last")
    joined = _carried(own, keys, [last], {"__before": F.last("__last", ignorenulls=True)})
    return joined.select(*df.columns, F.coalesce("__own", "__before").alias(name))
