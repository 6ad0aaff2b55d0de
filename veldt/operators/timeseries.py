"""Time series: windows, rates with resets, sessions, quantiles of histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators import scan


def windowed_counts(df: DataFrame, at: str, width: str, slide: str | None, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Rows (keys, window_start, measures) of tumbling windows, or sliding ones if ``slide`` is given."""
    w = F.window(F.col(at).cast("timestamp"), width, slide or width)
    return df.groupBy(*keys, w.alias("w")).agg(*[m.alias(k) for k, m in measures.items()]).select(*keys, F.col("w.start").alias("window_start"), *measures)


def _micros(df: DataFrame, at: str) -> Column:
    """A time column as whole microseconds; numbers stay."""
    return F.unix_micros(F.col(at).cast("timestamp")) if _is_time(df, at) else F.col(at).cast("long")


def _is_time(df: DataFrame, at: str) -> bool:
    return df.schema[at].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")


def increases(df: DataFrame, series: list[str], at: str, value: str, hot_rows: int | None = None) -> DataFrame:
    """``df`` with ``increase``: by how much a counter grew since the sample before; after a reset its whole value, at first 0.

    Samples of a series have times of their own and values that aren't null. A series of any length is spread, see ``scan``.
    """
    told = scan.last_known(df.withColumn("__at", _micros(df, at)), series, "__at", value, F.col(value), "__before", True, hot_rows)
    grown = F.when(F.col("__before").isNull(), F.lit(0.0)).when(F.col(value) < F.col("__before"), F.col(value)).otherwise(F.col(value) - F.col("__before"))
    return told.withColumn("increase", grown).drop("__at", "__before")


def rate(df: DataFrame, series: list[str], at: str, value: str, seconds: int) -> DataFrame:
    """Rows (series, window_start, rate): growth of a counter per second in tumbling windows of ``seconds``."""
    grown = increases(df, series, at, value)
    return windowed_counts(grown, at, f"{seconds} seconds", None, series, {"rate": F.sum("increase") / seconds})


def range_increases(df: DataFrame, series: list[str], at: str, value: str, seconds: int, hot_rows: int | None = None) -> DataFrame:
    """``df`` with ``increase``: by how much a counter grew from the first sample of the last ``seconds`` (ends included) to this one, over resets.

    Growth is summed up from the first sample of a series on. Each sample asks for the sum at the first sample that isn't before its
    range: samples and questions are merged by time, backwards, and the last sample seen answers. So a row costs the same
    however many samples its range holds. Samples as in ``increases``.
    """
    grown = increases(df, series, at, value, hot_rows).withColumn("__at", _micros(df, at))
    summed = scan.totals(grown, series, "__at", {"__sum": ("sum", F.col("increase"))}, hot_rows=hot_rows)
    sample = summed.withColumn("__back", -F.col("__at")).withColumn("__asks", F.lit(False))
    question = summed.withColumn("__back", -(F.col("__at") - F.lit(seconds * 1_000_000 if _is_time(df, at) else seconds))).withColumn("__asks", F.lit(True))
    met = scan.last_known(sample.unionByName(question), series, "__back", "__asks", F.when(~F.col("__asks"), F.col("__sum")), "__first", hot_rows=hot_rows)
    return met.where("__asks").select(*df.columns, (F.col("__sum") - F.col("__first")).alias("increase"))


def sessions(df: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Rows (key, start, end, n): runs of events of a key with no gap of ``gap_seconds`` or more between neighbours."""
    w = F.session_window(F.col(at).cast("timestamp"), f"{gap_seconds} seconds")
    return df.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")).select(key, F.col("w.start").alias("start"), F.col("last").alias("end"), "n")


def bucket_counts(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Rows (keys, le, n): cumulative counts of a histogram; the last bound stands for all."""
    les = F.array(*[F.lit(float(b)) for b in [*bounds, float("inf")]])
    # each value goes to its own bucket; sums over the few buckets make them cumulative
    own = F.element_at(F.filter(les, lambda b: b >= F.col(value)), 1)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, own.alias("le")).agg(F.count(F.lit(1)).alias("n"))
    all_les = counts.select(*keys).distinct().select(*keys, F.explode(les).alias("le"))
    dense = all_les.join(counts, [*keys, "le"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = Window.partitionBy(*keys).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("n", F.sum("n").over(upto))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Rows (keys, quantile) of cumulative buckets (keys, le, n): linear inside the bucket that holds the q-th value.

    The lowest bucket starts at 0; in the bucket without a bound the answer is the highest bound; without values it is null.
    """
    w = Window.partitionBy(*keys).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*keys))
    rows = buckets.select("*", F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"), F.coalesce(F.lag("n").over(w), F.lit(0)).alias("below"), (total * q).alias("rank"), total.alias("total"))
    hit = rows.where((F.col("n") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | ((F.col("rank") <= 0) & (F.col("low") == 0))))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    value = F.when(F.col("total") == 0, F.lit(None)).when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    first = hit.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))
    return first
