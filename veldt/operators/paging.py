"""Pages, windows and batches of an ordered feed. Limits are the feature here; all of them stop at a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, cursor: str, after: int, limit: int) -> DataFrame:
    """The page of ``limit`` rows after the cursor, with ``has_more`` and ``next_cursor`` on each row.

    One row more is read to tell whether there is a next page; a cursor behind all rows gives no rows.
    """
    ahead = df.where(F.col(cursor) > after).orderBy(cursor).limit(limit + 1)
    whole = Window.partitionBy()
    page = ahead.withColumn("__rn", F.row_number().over(Window.partitionBy().orderBy(cursor)))
    page = page.withColumn("has_more", F.count(F.lit(1)).over(whole) > limit).where(F.col("__rn") <= limit).drop("__rn")
    return page.withColumn("next_cursor", F.greatest(F.lit(after), F.max(cursor).over(whole)).cast("long"))


def resend_window(df: DataFrame, cursor: str, upto: int, at: str, since: Column, limit: int) -> DataFrame:
    """The newest ``limit`` rows at or below the cursor that are not older than ``since``, oldest first."""
    recent = df.where((F.col(cursor) <= upto) & (F.col(at) >= since))
    return recent.orderBy(F.col(cursor).desc()).limit(limit).orderBy(cursor)


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Page number ``page`` (from 0) of ``size`` rows by ``order``, which must be total."""
    return df.orderBy(*order).offset(page * size).limit(size)


def budget_batch(df: DataFrame, order: list[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """The longest prefix by ``order`` of at most ``most_rows`` rows and ``most_size`` in sum of ``size``, but at least one row.

    Rows beyond ``most_rows`` never count, so the running sum is over a bounded set.
    """
    first = df.orderBy(*order).limit(most_rows)
    w = Window.partitionBy().orderBy(*order)
    running = first.withColumn("position", F.row_number().over(w)).withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return running.where((F.col("position") == 1) | (F.col("running") <= most_size))


def claim(df: DataFrame, done: str, order: str, limit: int) -> DataFrame:
    """The oldest ``limit`` rows that aren't done: what an outbox relay publishes next."""
    return df.where(F.col(done).isNull()).orderBy(order).limit(limit)
