"""Sessions, updates by join, matching in rounds, overlaps, policies: operators on identities and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators.joins import mutual_best
from veldt.operators.shared import written
from veldt.operators.stats import count_where, ratio


def update_from(df: DataFrame, changes: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with ``columns`` (own name to name in ``changes``) replaced where ``changes`` has the key, and ``updated``.

    ``changes`` has a key at most once; a null in it is a value.
    """
    side = changes.select(F.col(key).alias("__key"), F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns.values())]).alias("__new"))
    joined = df.join(side, df[key] == side["__key"], "left")
    hit = F.col("__key").isNotNull()
    new = {own: F.when(hit, F.col(f"__new.c{k}")).otherwise(F.col(own)) for k, own in enumerate(columns)}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns], hit.alias("updated"))


def active(revoked: Column, expires: Column, now: Column, *others: Column) -> Column:
    """Neither revoked nor expired, and no other party revoked; null means never."""
    out = revoked.isNull() & F.coalesce(expires > now, F.lit(True))
    for x in others:
        out = out & x.isNull()
    return out


def in_grace(sessions: DataFrame, key: str, successor: str, replaced_at: str, used: Column, now: Column, seconds: int) -> DataFrame:
    """``sessions`` with ``usable``: not replaced, or replaced by an unused successor at most ``seconds`` ago.

    ``replaced_at`` and ``now`` are microseconds. The successor is a row of the same table.
    """
    after = sessions.select(F.col(key).alias("__key"), used.alias("__used"))
    joined = sessions.join(after, sessions[successor] == after["__key"], "left")
    recent = F.col(replaced_at) + seconds * 1_000_000 >= now
    return joined.withColumn("usable", F.col(successor).isNull() | (F.coalesce(~F.col("__used"), F.lit(False)) & recent)).drop("__key", "__used")


def match_rounds(pairs: DataFrame, left: str, right: str, score: str, least: float) -> DataFrame:
    """Rows (left, right, score, round): mutual best pairs are taken out and the rest is matched again until none is left.

    The first round's share is large: every round takes at least the best pair of what is left in each connected part. A chain in
    which each row prefers the next takes as many rounds as it has pairs; each round reads and writes what is left.
    """
    rest = written(pairs.select(left, right, score).where(F.col(score) >= least), "pairs")
    found: DataFrame | None = None
    number = 0
    while not rest.isEmpty():
        number += 1
        taken = written(mutual_best(rest, left, right, score), "taken").withColumn("round", F.lit(number))
        found = taken if found is None else found.unionByName(taken)
        rest = written(rest.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti").select(left, right, score), "pairs")
    return found if found is not None else rest.withColumn("round", F.lit(0))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(Dice, intersection over union) of two arrays as sets; 1 if both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(x, y))
    both = F.size(x) + F.size(y)
    return F.when(both == 0, 1.0).otherwise(2 * common / both), F.when(both == 0, 1.0).otherwise(common / (both - common))


def policies(df: DataFrame, truth: Column, decisions: dict[str, Column], groups: list[str]) -> DataFrame:
    """Rows (groups, policy, coverage, accuracy, recall): decisions may be null, which is to abstain."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), d.cast("boolean").alias("d")) for n, d in decisions.items()]))
    rows = df.select(*groups, truth.cast("boolean").alias("y"), each.alias("p")).select(*groups, "y", "p.policy", "p.d")
    said = F.col("d").isNotNull()
    return rows.groupBy(*groups, "policy").agg(
        ratio(count_where(said), F.count(F.lit(1))).alias("coverage"),
        ratio(count_where(said & (F.col("d") == F.col("y"))), count_where(said)).alias("accuracy"),
        ratio(count_where(F.col("d") & F.col("y")), count_where(said & F.col("y"))).alias("recall"),
    )


def control_pairs(df: DataFrame, key: str, known: DataFrame, a: str, b: str, per_row: int, seed: int) -> DataFrame:
    """Rows (a, b), a < b: pairs of rows that are not ``known``, for each row up to ``per_row`` partners drawn by a hash.

    Rows are numbered in no special order by their rank inside hash buckets; a partner is a row of a bucket that the hash
    names, so the number of pairs is linear. Keys are longs.
    """
    n = max(1, df.count())
    mark = lambda *of: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *of).cast("binary")), 1, 13), 16, 10).cast("long")
    spot = lambda k: F.pmod(mark(F.col(key).cast("string"), k.cast("string")), F.lit(n))
    places = df.select(F.col(key).alias("__b"), F.pmod(mark(F.col(key).cast("string")), F.lit(n)).alias("__spot"))
    asks = df.select(F.col(key).alias("__a"), F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("__k"), F.col(key)).withColumn("__spot", spot(F.col("__k")))
    drawn = asks.join(places, "__spot").groupBy("__a", "__k").agg(F.min("__b").alias("__b")).where("__a <> __b")
    pairs = drawn.select(F.least("__a", "__b").alias(a), F.greatest("__a", "__b").alias(b)).distinct()
    return pairs.join(known.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)), [a, b], "left_anti")
