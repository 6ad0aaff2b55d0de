"""Operators on rows of one key: latest, first, history, baseline, limits for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators import scan

#: What can keep a change from being computed, in the order in which it is told.
REASONS = ("captured after receipt", "no earlier measurement", "baseline not before current", "baseline is not positive")


def _names(columns: str | list[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def latest_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The row of each key that is largest by ``order``; other columns, nulls included, are those of that row.

    An aggregation and no window: rows combine in each task before the shuffle, so a hot key costs one row a task.
    Null keys form one group. Order columns that tie leave an arbitrary one of the tied rows; end with a unique column.
    """
    keys = _names(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col("__best")[c].alias(c) for c in df.columns])


def first_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The row of each key that is smallest by ``order``: the first occurrence."""
    keys = _names(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col("__best")[c].alias(c) for c in df.columns])


def as_of(df: DataFrame, key: str | list[str], at: str, limit: Column, order: list[str]) -> DataFrame:
    """The latest row of each key among those with ``at`` before ``limit``: a later row never hides an earlier one."""
    return latest_per_key(df.where(F.col(at) < limit), key, order)


def history_before(df: DataFrame, key: str, at: str, measures: dict[str, tuple[str, Column]], hot_rows: int | None = None) -> DataFrame:
    """``df`` with ``measures`` over the rows of the same key that are strictly before its own ``at``, by day.

    A measure is (count, sum, min or max) and a column. A range frame over days keeps rows of the same day out; the frame only grows, so a long
    history costs one pass, and that of a key of many rows is spread, see ``scan``.
    """
    days = F.datediff(F.col(at), F.lit("1970-01-01").cast("date")).cast("long")
    return scan.totals(df.withColumn("__day", days), [key], "__day", measures, True, hot_rows).drop("__day")


def baseline_change(df: DataFrame, key: str, at: str, tie: str, value: str, after_weeks: float = 4.0, below_percent: float = 50.0) -> DataFrame:
    """For each key: the percentage by which the latest value is below the earliest one, and whether that stalled.

    Columns: key, change_percent, weeks, stalled, reason. Where nothing can be computed the reason says why and the other
    columns are null or false. Earliest and latest go by ``at``, then ``tie``.
    """
    order = F.struct(at, tie)
    ends = df.groupBy(key).agg(
        F.min_by(F.struct(F.col(at).alias("at"), F.col(value).alias("v")), order).alias("a"),
        F.max_by(F.struct(F.col(at).alias("at"), F.col(value).alias("v")), order).alias("b"),
        F.count(F.lit(1)).alias("n"),
    )
    reason = (
        F.when(F.col("n") < 2, REASONS[1])
        .when(F.col("a.at") >= F.col("b.at"), REASONS[2])
        .when(F.col("a.v").isNull() | (F.col("a.v") <= 0), REASONS[3])
    )
    change = F.when(reason.isNull(), (F.col("a.v") - F.col("b.v")) / F.col("a.v") * 100)
    weeks = F.when(reason.isNull(), F.datediff("b.at", "a.at") / 7)
    stalled = F.coalesce((weeks >= after_weeks) & (change < below_percent), F.lit(False))
    return ends.select(key, change.alias("change_percent"), weeks.alias("weeks"), stalled.alias("stalled"), reason.alias("reason"))


def lateral_top1(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[str], columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the largest row by ``order`` of ``right`` for its key; nulls where there is none."""
    top = latest_per_key(right.select(right_key, *dict.fromkeys([*order, *columns])), right_key, order)
    top = top.select(F.col(right_key).alias("__key"), *[F.col(c) for c in columns])
    return left.join(top, left[left_key] == top["__key"], "left").drop("__key")


def per_group_limit(df: DataFrame, key: str | list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, with their rank. Spark cuts each task's rows to ``n`` a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*_names(key)).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def superseded(df: DataFrame, key: str, revision: str) -> DataFrame:
    """``df`` with ``is_current``: whether its revision is the highest of its key."""
    best = df.groupBy(F.col(key).alias("__key")).agg(F.max(revision).alias("__best"))
    return df.join(best, df[key].eqNullSafe(F.col("__key"))).withColumn("is_current", F.col(revision) == F.col("__best")).drop("__key", "__best")
