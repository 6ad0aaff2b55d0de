"""Event processing as batch operators: duplicates, supersession, retries, state machines, cursors, archives, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators.keyed import latest_per_key
from veldt.operators.ordering import running_totals
from veldt.operators.stats import count_where


def classify(df: DataFrame, event: str, entity: str, revision: str, order: str) -> DataFrame:
    """``df`` with ``outcome``: what a store that accepts each event once would say to each row, in the order of ``order``.

    persisted: first row of its event, and of its (entity, revision); deduplicated: the event came before; conflict: another event has the
    same entity and revision already. ``order`` is unique. Earliest rows are found by aggregation, so a row that comes a million times combines in its tasks.
    """
    first = df.groupBy(F.col(event).alias("__event")).agg(F.min(order).alias("__first"))
    with_first = df.join(first, df[event].eqNullSafe(F.col("__event"))).drop("__event")
    fresh = with_first.where(F.col(order) == F.col("__first"))
    owner = fresh.groupBy(F.col(entity).alias("__entity"), F.col(revision).alias("__rev")).agg(F.min(order).alias("__owner"))
    joined = with_first.join(owner, with_first[entity].eqNullSafe(F.col("__entity")) & with_first[revision].eqNullSafe(F.col("__rev")), "left")
    outcome = F.when(F.col(order) != F.col("__first"), "deduplicated").when(F.col(order) == F.col("__owner"), "persisted").otherwise("conflict")
    return joined.select(*df.columns, outcome.alias("outcome"))


def upsert_greatest(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, value) of both tables with the greater value of each key: a cursor never goes back."""
    return old.select(key, value).unionByName(new.select(key, value)).groupBy(key).agg(F.max(value).alias(value))


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of both tables, the largest by ``order`` of each key."""
    return latest_per_key(old.unionByName(new), key, order)


def conditional_upsert(old: DataFrame, new: DataFrame, key: str, scope: str, value: str) -> DataFrame:
    """Rows (key, value, status): ``updated`` where key and scope match, ``not_found`` for another scope, ``inserted`` for a new key."""
    before = old.select(F.col(key).alias("__key"), F.col(scope).alias("__scope"))
    joined = new.join(before, new[key] == before["__key"], "left")
    status = F.when(F.col("__key").isNull(), "inserted").when(F.col("__scope").eqNullSafe(F.col(scope)), "updated").otherwise("not_found")
    return joined.select(key, value, status.alias("status"))


def insert_absent(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key is new, the first by ``order`` of each."""
    known = old.select(F.col(key).alias("__key")).distinct()
    absent = new.join(known, new[key] == known["__key"], "left_anti")
    rest = [c for c in new.columns if c != key]
    best = absent.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest]).select(new.columns)


def save_outcomes(df: DataFrame, known: DataFrame, key: str, stable: str, body: str, order: str) -> DataFrame:
    """``df`` with ``outcome``: what a store says to answers that race for a key; ``known`` has what it holds already (key, stable, body).

    The first answer of a key, there or here by the unique ``order``, claims the key for its ``stable`` part. Others of that part are saved
    if their body is new to the key and otherwise ``already_answered``; those of another part are a ``conflict``. Nulls equal nulls.
    Firsts are found by partial aggregation, so a key that comes a million times combines in its tasks.
    """
    there = known.select(F.col(key).alias("__k"), F.col(stable).alias("__s"), F.col(body).alias("__b"), F.lit(None).cast(df.schema[order].dataType).alias("__o"))
    here = df.select(F.col(key).alias("__k"), F.col(stable).alias("__s"), F.col(body).alias("__b"), F.col(order).alias("__o"))
    # what is there already has no place in the order and comes first
    each = here.unionByName(there).groupBy("__k", "__s", "__b").agg(F.min(F.struct(F.col("__o").isNotNull().alias("later"), "__o")).alias("__first"))
    claims = each.groupBy("__k").agg(F.min_by(F.struct("__s"), "__first").alias("claim"))
    met = each.alias("e").join(claims.alias("c"), F.expr("e.__k <=> c.__k"))
    told = met.select("e.__k", "e.__s", "e.__b", "e.__first", F.expr("c.claim.__s <=> e.__s").alias("__own"))
    same = [F.col(f"d.{a}").eqNullSafe(F.col(f"t.{b}")) for a, b in ((key, "__k"), (stable, "__s"), (body, "__b"))]
    joined = df.alias("d").join(told.alias("t"), same[0] & same[1] & same[2])
    first = F.col("t.__first.later") & F.col("t.__first.__o").eqNullSafe(F.col(f"d.{order}"))
    return joined.select("d.*", F.when(~F.col("t.__own"), "conflict").when(first, "saved").otherwise("already_answered").alias("outcome"))


def low_watermarks(readers: DataFrame, cursors: DataFrame, group: str, reader: str, cursor: str, active: Column) -> DataFrame:
    """Rows (group, floor, n_readers): the lowest cursor of each group's active readers.

    A reader without a cursor counts as 0; a group without active readers has a null floor, which holds nothing back.
    """
    side = cursors.select(F.col(reader).alias("__reader"), F.col(cursor).alias("__cursor"))
    joined = readers.withColumn("__active", active).join(side, readers[reader] == side["__reader"], "left")
    return joined.groupBy(group).agg(
        F.min(F.when(F.col("__active"), F.coalesce("__cursor", F.lit(0)))).alias("floor"), count_where(F.col("__active")).alias("n_readers")
    )


def held_back(readers: DataFrame, cursors: DataFrame, group: str, reader: str, cursor: str) -> DataFrame:
    """Rows (group, reader, cursor): the slowest reader of each group, the smallest name on ties."""
    side = cursors.select(F.col(reader).alias("__reader"), F.col(cursor).alias("__cursor"))
    joined = readers.join(side, readers[reader] == side["__reader"], "left").withColumn("__c", F.coalesce("__cursor", F.lit(0)).cast("long"))
    worst = joined.groupBy(group).agg(F.min(F.struct(F.col("__c").alias("c"), F.col(reader).alias("r"))).alias("m"))
    return worst.select(group, F.col("m.r").alias(reader), F.col("m.c").alias(cursor))


def split_archive(feed: DataFrame, floors: DataFrame, group: str, seq: str, at: str, before: Column) -> DataFrame:
    """``feed`` with ``archived``: older than ``before`` and seen by every active reader of the group.

    Write the two halves apart to move rows: one pass decides for both.
    """
    side = floors.select(F.col(group).alias("__group"), "floor")
    joined = feed.join(side, feed[group].eqNullSafe(F.col("__group")), "left")
    seen = F.col("floor").isNull() | (F.col(seq) <= F.col("floor"))
    return joined.withColumn("archived", (F.col(at) < before) & seen).drop("__group", "floor")


def retention(longest: Column, margin: Column) -> Column:
    """Longest retention plus a margin; null (keep all) where the retention is unknown or endless (negative)."""
    return F.when(longest.isNotNull() & (longest >= 0), longest + margin)


def route(attempts: Column, failed: Column, delays: list[tuple[str, int]]) -> tuple[Column, Column]:
    """(target, delay in seconds): where a message goes after an attempt. Failures go through ``delays`` in order, then to ``dead``."""
    target, delay = F.when(~failed, "done"), F.when(~failed, 0)
    for k, (name, seconds) in enumerate(delays):
        target, delay = target.when(attempts == k, name), delay.when(attempts == k, seconds)
    return target.otherwise("dead"), delay.otherwise(0)


def split_bad(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with ``dlq_reason``): nothing is dropped."""
    marked = df.withColumn("dlq_reason", problem)
    return marked.where("dlq_reason IS NULL").drop("dlq_reason"), marked.where("dlq_reason IS NOT NULL")


def furthest_state(df: DataFrame, key: str, state: str, ranks: dict[str, int]) -> DataFrame:
    """Rows (key, state, n_moves): the furthest state each key has reached; states never go back, unknown ones raise."""
    lookup = F.create_map(*[x for name, k in ranks.items() for x in (F.lit(name), F.lit(k))])
    rank = F.coalesce(lookup[F.col(state)], F.raise_error(F.concat(F.lit("unknown state "), F.coalesce(F.col(state), F.lit("null")))).cast("int"))
    best = df.select(key, F.struct(rank.alias("rank"), F.col(state).alias("state")).alias("s")).groupBy(key)
    return best.agg(F.max("s").alias("m"), F.count_distinct("s").alias("n_moves")).select(key, F.col("m.state").alias("state"), "n_moves")


def lifetimes(df: DataFrame, family: str, start: str, end: str) -> DataFrame:
    """Rows (family, first_start, last_end, n): a family's life goes from its first start to the end of its last member.

    The end of the last member counts even if it is null: then the family is still alive.
    """
    return df.groupBy(family).agg(F.min(start).alias("first_start"), F.max_by(end, start).alias("last_end"), F.count(F.lit(1)).alias("n"))


def drain_time(df: DataFrame, at: str, lag: str) -> DataFrame:
    """One row (max_lag, first_busy, drained): the first sample with lag, and the first without after the last one with."""
    busy = df.agg(F.max(lag).alias("max_lag"), F.min(F.when(F.col(lag) > 0, F.col(at))).alias("first_busy"), F.max(F.when(F.col(lag) > 0, F.col(at))).alias("__last"))
    idle = df.where(F.col(lag) == 0).select(F.col(at).alias("__at")).join(F.broadcast(busy.select("__last")), F.col("__at") > F.col("__last"))
    return busy.crossJoin(F.broadcast(idle.agg(F.min("__at").alias("drained")))).drop("__last")  # one row each


def running_prefix(df: DataFrame, order: str, amount: str, budget: float) -> DataFrame:
    """Rows of the longest prefix by ``order`` whose sum of ``amount`` stays within ``budget``, over a table of any size."""
    return running_totals(df, [], order, F.col(amount), "running").where(F.col("running") <= budget)


def within_budget(df: DataFrame, key: str, at: str, width: str, budget: int, order: str) -> DataFrame:
    """``df`` with ``admitted``: the first ``budget`` rows of a key in each window of ``width``, by time and ``order``."""
    window = F.window(F.col(at), width)["start"]
    place = F.row_number().over(Window.partitionBy(key, "__window").orderBy(at, order))
    return df.withColumn("__window", window).withColumn("admitted", place <= budget).drop("__window")
