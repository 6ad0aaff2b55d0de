"""Running totals and ranks over a whole table or a hot group without putting it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators.shared import written

SLICES = 64


def running_totals(df: DataFrame, groups: list[str], order: str, amount: Column, name: str = "running", slices: int = SLICES) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows of its group up to its own, by ``order``.

    ``order`` is numeric and differs between the rows of a group (aggregate ties first); nulls come first. Rows are cut into ``slices`` by quantiles of
    ``order``; slices are summed up, the few sums are accumulated, and each slice runs on its own from there. So no task
    gets a whole group. The result doesn't depend on how good the quantiles are, only the balance does.
    """
    bounds = df.select(F.col(order).cast("double").alias("v")).approxQuantile("v", [k / slices for k in range(1, slices)], 0.01)
    cuts = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    cut = df.withColumn("__slice", F.size(F.filter(cuts, lambda b: b <= F.col(order).cast("double"))))
    cut = cut.withColumn("__amount", amount)
    keys = [*groups, "__slice"]
    sums = cut.groupBy(*keys).agg(F.sum("__amount").alias("__sum"))
    before = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], "__before")
    match = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        match = one if match is None else match & one
    own = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(sums, match).withColumn(name, F.col("__before") + F.sum("__amount").over(own))
    return joined.select(*df.columns, name)


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Rows (groups, value, n, upto): how often each non-null value occurs, and how many values are at most as large."""
    # written, as the cuts into slices and the totals both read them
    counts = written(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")), "counts")
    return running_totals(counts, groups, value, F.col("n"), "upto")
