"""Evaluation of scores against labels: rank statistics, gaps between groups, thresholds, resampling, votes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators.ordering import value_counts
from veldt.operators.stats import count_where, ratio


def auroc(df: DataFrame, truth: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Rows (groups, n_pos, n_neg, auroc): the Mann-Whitney statistic, ties counted half; null with one class only.

    Rows with a null truth or score are left out. Scores are counted first and ranked in slices.
    """
    groups = groups or []
    rows = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).withColumn("__y", F.col(truth).cast("boolean").cast("int"))
    ranks = value_counts(rows, groups, score)
    pos = rows.where("__y = 1").groupBy(*groups, score).agg(F.count(F.lit(1)).alias("__pos"))
    both = [*groups, score]
    right = pos.select(*[F.col(c).alias(f"__{c}") for c in both], "__pos")
    match = None
    for c in both:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        match = one if match is None else match & one
    joined = ranks.join(right, match, "left").withColumn("__p", F.coalesce("__pos", F.lit(0)))
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    out = joined.groupBy(*groups).agg(F.sum("__p").alias("n_pos"), F.sum(F.col("n") - F.col("__p")).alias("n_neg"), F.sum(rank * F.col("__p")).alias("__sum"))
    value = (F.col("__sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return out.select(*groups, F.col("n_pos").cast("long"), F.col("n_neg").cast("long"), F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), value).alias("auroc"))


def rates_at(df: DataFrame, truth: str, score: str, threshold: float, groups: list[str] | None = None) -> DataFrame:
    """Rows (groups, n, accuracy, sensitivity, specificity) of score >= threshold; a rate without rows is null."""
    y, p = F.col(truth).cast("boolean"), F.col(score) >= threshold
    return (
        df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
        .groupBy(*(groups or []))
        .agg(
            F.count(F.lit(1)).alias("n"),
            ratio(count_where(p == y), F.count(F.lit(1))).alias("accuracy"),
            ratio(count_where(p & y), count_where(y)).alias("sensitivity"),
            ratio(count_where(~p & ~y), count_where(~y)).alias("specificity"),
        )
    )


def gap_report(df: DataFrame, truth: str, score: str, group: str, threshold: float, most_auroc_gap: float = 0.01, most_rate_gap: float = 0.03) -> DataFrame:
    """One row: the largest differences between groups in AUROC, sensitivity and specificity, and a verdict.

    The verdict is PASS or FAIL against the allowed gaps, UNCLEAR if a gap can't be computed.
    """
    per = auroc(df, truth, score, [group]).join(rates_at(df, truth, score, threshold, [group]), group)
    gap = lambda c: (F.max(c) - F.min(c)).alias(f"{c}_gap")
    out = per.agg(F.count(F.lit(1)).alias("n_groups"), gap("auroc"), gap("sensitivity"), gap("specificity"))
    odds = F.greatest("sensitivity_gap", "specificity_gap")
    unclear = F.col("auroc_gap").isNull() | F.col("sensitivity_gap").isNull() | F.col("specificity_gap").isNull()
    verdict = F.when(unclear, "UNCLEAR").when((F.col("auroc_gap") <= most_auroc_gap) & (odds <= most_rate_gap), "PASS").otherwise("FAIL")
    return out.withColumn("odds_gap", odds).withColumn("verdict", verdict)


def confusion(df: DataFrame, truth: Column, predicted: Column, ordered: bool = True) -> DataFrame:
    """Rows (truth, predicted, n, within_one): counts of each pair of classes; within_one for classes given as numbers."""
    pairs = df.select(truth.alias("truth"), predicted.alias("predicted")).groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("within_one", F.abs(F.col("truth") - F.col("predicted")) <= 1) if ordered else pairs


def threshold_sweep(df: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """Rows (threshold, n_pred, hits, balanced, best): balanced accuracy at each threshold and which is best, lowest on ties.

    Each row is counted once for the thresholds it passes: the list is a parameter, so its explode is bounded.
    """
    points = F.array(*[F.lit(float(t)) for t in thresholds])
    y = F.col(truth).cast("boolean")
    each = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(y.alias("y"), F.col(score).alias("s"), F.explode(points).alias("threshold"))
    pred = F.col("s") >= F.col("threshold")
    out = each.groupBy("threshold").agg(
        count_where(pred).alias("n_pred"),
        count_where(pred & F.col("y")).alias("hits"),
        ((ratio(count_where(pred & F.col("y")), count_where(F.col("y"))) + ratio(count_where(~pred & ~F.col("y")), count_where(~F.col("y")))) / 2).alias("balanced"),
    )
    best = out.agg(F.max_by("threshold", F.struct("balanced", -F.col("threshold"))).alias("__best"))
    return out.crossJoin(F.broadcast(best)).withColumn("best", F.col("threshold") == F.col("__best")).drop("__best")  # one row


def bin_summary(df: DataFrame, value: str, edges: list[float], measures: dict[str, Column]) -> DataFrame:
    """Rows (bin, n, measures): bin k holds values from edge k on to below the next; below the first edge it is 0."""
    number = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(value)))
    return df.where(F.col(value).isNotNull()).groupBy(number.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()])


#: Chances that a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998980)


def bootstrap_mean(df: DataFrame, key: str, value: str, replicates: int) -> DataFrame:
    """One row (mean, low, high): mean of ``value`` and the 2.5 and 97.5 % points of its Poisson bootstrap.

    A row's weight in a replicate is a Poisson number drawn from seven of the 32 digits of a hash of its key and a quarter of the
    replicate's number, so the result repeats anywhere. Rows aren't multiplied: each task adds up ``replicates`` sums.
    """
    steps = np.array(POISSON)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, low = np.zeros(replicates), np.zeros(replicates)
        suffixes = [f":{k}".encode() for k in range(-(-replicates // 4))]
        for batch in batches:
            values = batch.column(1).to_numpy(zero_copy_only=False)
            for begin in range(0, len(values), 1024):
                keys = [str(k).encode() if k is not None else b"" for k in batch.column(0).slice(begin, 1024).to_pylist()]
                drawn = np.frombuffer(b"".join([hashlib.md5(k + s).digest() for k in keys for s in suffixes]), ">u4").reshape(len(keys), -1)[:, :replicates]
                weights = np.searchsorted(steps, (drawn >> 4) / 16**7, side="right")
                top += values[begin : begin + 1024] @ weights
                low += weights.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(top), pa.array(low)], ["r", "top", "low"])

    rows = df.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    means = rows.mapInArrow(sums, "r long, top double, low double").groupBy("r").agg(ratio(F.sum("top"), F.sum("low")).alias("m"))  # as many rows as replicates
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(ends))  # one row each


def vote(df: DataFrame, item: str, label: str, weight: str) -> DataFrame:
    """Rows (item, label, mean): the label of each item with the largest mean weight, smallest label on ties."""
    means = df.groupBy(item, label).agg(F.avg(weight).alias("mean"))
    return means.groupBy(item).agg(F.max_by(F.struct(label, "mean"), F.struct(F.col("mean"), -F.col(label))).alias("b")).select(item, F.col(f"b.{label}"), "b.mean")
