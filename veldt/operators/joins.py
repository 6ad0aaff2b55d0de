"""Joins by what they ask: flags for membership, stale references, missing sides, mutual best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def membership(df: DataFrame, key: str, others: dict[str, DataFrame]) -> DataFrame:
    """``df`` with a boolean for each other table (one column of keys): whether the key is in it. No row is lost or doubled.

    A membership test under OR, or several of them, needs flags and not semi-joins. Keys are made distinct before the join.
    """
    for name, other in others.items():
        keys = other.select(F.col(other.columns[0]).alias("__key")).where("__key IS NOT NULL").distinct().withColumn(f"__{name}", F.lit(True))
        df = df.join(keys, df[key] == keys["__key"], "left").drop("__key")
        df = df.withColumn(name, F.coalesce(F.col(f"__{name}"), F.lit(False))).drop(f"__{name}")
    return df


def not_yet(df: DataFrame, known: DataFrame, key: str, known_key: str) -> DataFrame:
    """Rows whose key is not in ``known``: insert once, deliver once."""
    return df.join(known.select(F.col(known_key).alias("__key")), df[key] == F.col("__key"), "left_anti")


def stale_references(current: DataFrame, snapshot: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows (key, state): snapshot rows whose row is gone (``missing``) or has another fingerprint (``changed``)."""
    now = current.select(F.col(key).alias("__key"), F.col(fingerprint).alias("__now"))
    joined = snapshot.join(now, snapshot[key] == now["__key"], "left")
    state = F.when(F.col("__key").isNull(), "missing").when(~F.col("__now").eqNullSafe(F.col(fingerprint)), "changed")
    return joined.select(key, state.alias("state")).where("state IS NOT NULL")


def strict_lookup(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` of ``dimension``; a key without a row raises when the result is computed."""
    side = dimension.select(F.col(dimension_key).alias("__key"), *columns, F.lit(True).alias("__found"))
    joined = df.join(side, df[key] == side["__key"], "left")
    problem = F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.when(F.col("__found").isNull(), F.raise_error(problem).cast(df.schema[key].dataType)).otherwise(F.col(key))
    return joined.select(*[checked.alias(c) if c == key else F.col(c) for c in df.columns], *columns)


def greatest_before(df: DataFrame, key: str, flag: Column, value: str, name: str) -> DataFrame:
    """Rows (key, name): the largest ``value`` among rows where ``flag`` holds; EXISTS with ``>`` becomes a comparison with it."""
    return df.where(flag).groupBy(key).agg(F.max(value).alias(name))


def mutual_best(pairs: DataFrame, left: str, right: str, score: str, least: float = 0.0) -> DataFrame:
    """Pairs (left, right, score) where each side is the other's best; ties go to the smaller name."""
    ok = pairs.where(F.col(score) >= least)
    best_left = ok.groupBy(left).agg(F.max_by(right, F.struct(F.col(score), -F.col(right))).alias("__r"))
    best_right = ok.groupBy(right).agg(F.max_by(left, F.struct(F.col(score), -F.col(left))).alias("__l"))
    return (
        ok.join(best_left, left)
        .where(F.col(right) == F.col("__r"))
        .join(best_right, right)
        .where(F.col(left) == F.col("__l"))
        .select(left, right, score)
    )
