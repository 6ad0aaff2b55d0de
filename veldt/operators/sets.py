"""Set operations over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_ids(*columns: DataFrame) -> DataFrame:
    """Distinct values of one-column tables, as ``id``."""
    return reduce(DataFrame.unionByName, [c.toDF("id") for c in columns]).distinct()


def difference_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (only_left, only_right, both): how many distinct values of two one-column tables lie where.

    A single aggregation over the union; equal sets have zero on both sides. Null is a value.
    """
    both = left.toDF("id").withColumn("l", F.lit(1)).withColumn("r", F.lit(0))
    both = both.unionByName(right.toDF("id").withColumn("l", F.lit(0)).withColumn("r", F.lit(1)))
    sides = both.groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    return sides.agg(
        n((F.col("l") == 1) & (F.col("r") == 0)).alias("only_left"),
        n((F.col("l") == 0) & (F.col("r") == 1)).alias("only_right"),
        n((F.col("l") == 1) & (F.col("r") == 1)).alias("both"),
    )


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, with ``surplus`` (negative: more often on the right)."""
    columns = left.columns
    both = left.withColumn("__n", F.lit(1)).unionByName(right.select(columns).withColumn("__n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("__n").cast("long").alias("surplus")).where("surplus <> 0")


def ordered_concat(order: list[str], *parts: DataFrame) -> DataFrame:
    """Rows of all parts with ``part``: their place is by part, then ``order``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])


def missing_of(expected: Column, seen: Column) -> Column:
    """Sorted members of ``expected`` that ``seen`` lacks; an empty array means that all were seen. Null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.coalesce(expected, none), F.coalesce(seen, none)))
