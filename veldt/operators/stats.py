"""Aggregates: exact percentiles by three definitions, fingerprints, ratios, spreads, lifetimes, completeness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators.ordering import value_counts
from veldt.operators.shared import written


def count_where(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """``part`` over ``whole``; null where the whole is zero."""
    return F.when(whole != 0, part / whole)


def percentiles(df: DataFrame, groups: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """One row a group: for each name and share q three exact percentiles, ``_even``, ``_ceil`` and ``_linear``.

    even: nearest rank whose index is round-half-even(q n + 0.5), clamped; ceil: rank ceil(q n), clamped; linear: between the
    neighbours of (n - 1) q. Null values don't count; a group without values has no row. Values are counted and ranked
    in slices, so a group of any size is spread over tasks.
    """
    counted = written(value_counts(df, groups, value), "ranks")  # read for the totals and for the points
    totals = counted.groupBy(*groups).agg(F.sum("n").alias("__total"))
    if groups:
        right = totals.select(*[F.col(g).alias(f"__{g}") for g in groups], "__total")
        match = None
        for g in groups:
            one = F.col(g).eqNullSafe(F.col(f"__{g}"))
            match = one if match is None else match & one
        ranked = counted.join(right, match)
    else:
        ranked = counted.crossJoin(F.broadcast(totals))  # one row
    total = F.col("__total")
    at = lambda k: F.max(F.when((k > F.col("upto") - F.col("n")) & (k <= F.col("upto")), F.col(value)))
    out = [F.max("__total").cast("long").alias("n_values")]
    for name, q in points.items():
        clamp = lambda k: F.greatest(F.lit(1), F.least(total, k.cast("long")))
        out.append(at(clamp(F.bround(F.lit(q) * total + 0.5))).alias(f"{name}_even"))
        out.append(at(clamp(F.ceil(F.lit(q) * total))).alias(f"{name}_ceil"))
        low, share = F.floor(F.lit(q) * (total - 1)), F.lit(q) * (total - 1) - F.floor(F.lit(q) * (total - 1))
        a, b = at(low + 1), at(F.least(total, low + 2))
        out.append((a + F.max(share) * (b - a)).alias(f"{name}_linear"))
    return ranked.groupBy(*groups).agg(*out)


def fingerprint(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row (n_rows, fingerprint): a digest of the rows in the order of ``key``, for tables of a bounded size such as dimensions.

    Columns are joined by a bar as text, null as an empty text; for tables of any size use ``fingerprint_unordered``.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line"))))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 256).alias("fingerprint"))


def fingerprint_unordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n_rows, low_sum, high_sum): sums over the rows of two 32-bit parts of each row's MD5.

    It doesn't depend on the order of the rows, counts repeated rows, and combines in each task: tables of any size.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    part = lambda a: F.coalesce(F.sum(F.conv(F.substring(F.md5(line.cast("binary")), a, 8), 16, 10).cast("decimal(38,0)")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), part(1).cast("string").alias("low_sum"), part(9).cast("string").alias("high_sum"))


def stage_times(df: DataFrame, key: str, stage: str, at: str, stages: list[str]) -> DataFrame:
    """One row a key: first time and count of each stage, the missing stages in order, and whether it is complete."""
    aggs = []
    for s in stages:
        aggs += [F.min(F.when(F.col(stage) == s, F.col(at))).alias(f"{s}_at"), count_where(F.col(stage) == s).alias(f"{s}_n")]
    out = df.groupBy(key).agg(*aggs)
    missing = F.array_compact(F.array(*[F.when(F.col(f"{s}_n") == 0, F.lit(s)) for s in stages]))
    return out.withColumn("missing", F.array_join(missing, ",")).withColumn("complete", F.size(missing) == 0)


def duplicate_counts(df: DataFrame, fingerprint: Column) -> DataFrame:
    """One row (n_rows, n_distinct, n_extra, n_groups): rows, different fingerprints, surplus rows, groups of several rows.

    Two aggregations, so that a group with a third of all rows is one row after the first.
    """
    sizes = df.groupBy(fingerprint.alias("__f")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_extra"),
        count_where(F.col("n") > 1).alias("n_groups"),
    )


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """Rows (size, n_keys): how many keys have how many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_keys"))


def least_squares(df: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """One row: the coefficients c_<input> of output ~ sum(c * input), by the normal equations.

    The sums combine in tasks; the driver solves a system of the number of inputs. Rows with a null are left out.
    """
    import numpy as np

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in [*inputs, output]]).dropna()
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(inputs) for j, b in enumerate([*inputs, output])]
    found = rows.agg(*sums).first()
    k = len(inputs)
    table = np.array([[found[f"{i}_{j}"] or 0.0 for j in range(k + 1)] for i in range(k)])
    solved = np.linalg.lstsq(table[:, :k], table[:, k], rcond=None)[0]
    return df.sparkSession.createDataFrame([tuple(float(x) for x in solved)], ", ".join(f"c_{c} double" for c in inputs))


def nearest(values: list[Column], centres: list[list[float]]) -> Column:
    """Number of the centre with the least square distance, the first of equal ones."""
    away = [sum(((v - c) * (v - c) for v, c in zip(values, centre)), F.lit(0.0)) for centre in centres]
    least = F.least(*away) if len(away) > 1 else away[0]
    return F.coalesce(*[F.when(d == least, F.lit(k)) for k, d in enumerate(away)])


def regions(df: DataFrame, key: str, values: list[str], k: int, rounds: int = 30) -> DataFrame:
    """Rows (region, n, percent, c_<value>): up to ``k`` groups of rows by nearest centre, largest first.

    The first centre is the row nearest to the mean, each next one the row farthest from all so far (ties by key); then centres
    move to the mean of their rows until none moves, ``rounds`` times at most. Percents are rounded half up to one place, what is
    left over goes to the largest. Every round is one aggregation over all rows; the driver holds ``k`` centres. Rows with
    a null value are left out; fewer different rows than ``k`` make fewer regions; an empty table gives none.
    """
    rows = df.select(F.col(key).alias("__key"), *[F.col(v).cast("double").alias(v) for v in values]).dropna(subset=values)
    columns = [F.col(v) for v in values]
    means = rows.agg(*[F.avg(v).alias(v) for v in values]).first()
    away = lambda centre: sum(((v - c) * (v - c) for v, c in zip(columns, centre)), F.lit(0.0))
    centres: list[list[float]] = []
    while means[0] is not None and len(centres) < k:
        far = F.least(*[away(c) for c in centres]) if len(centres) > 1 else away(centres[0]) if centres else -away(list(means))
        best = rows.agg(F.max_by(F.struct(far.alias("far"), *columns), F.struct(far, -F.col("__key"))).alias("b")).first()["b"]
        if centres and best["far"] == 0:
            break
        centres.append([best[v] for v in values])
    if not centres:
        return df.sparkSession.createDataFrame([], "region long, n long, percent double, " + ", ".join(f"c_{v} double" for v in values))
    found: list = []
    for _ in range(rounds):
        found = rows.groupBy(nearest(columns, centres).alias("r")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values]).collect()
        moved = [list(c) for c in centres]
        for row in found:
            moved[row["r"]] = [row[v] for v in values]
        if moved == centres:
            break
        centres = moved
    sizes = {row["r"]: row["n"] for row in rows.groupBy(nearest(columns, centres).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(sizes, key=lambda r: (-sizes[r], r))
    total = sum(sizes.values())
    percents = [math.floor(sizes[r] / total * 1000 + 0.5) / 10 for r in order]
    percents[0] = math.floor((percents[0] + 100 - sum(percents)) * 10 + 0.5) / 10
    out = [(place + 1, sizes[r], p, *centres[r]) for place, (r, p) in enumerate(zip(order, percents))]
    return df.sparkSession.createDataFrame(out, "region long, n long, percent double, " + ", ".join(f"c_{v} double" for v in values))
