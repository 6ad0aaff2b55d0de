"""Row rules, decision tables and guards that fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows (key, rule): each rule that a row breaks. A rule is a condition that has to hold; null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def first_problem(rules: dict[str, Column]) -> Column:
    """The name of the first broken rule in order, or null."""
    return F.coalesce(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()])


def unknown_keys(document: str, known: list[str]) -> Column:
    """Sorted top-level keys of a JSON text outside ``known``; null if the text isn't an object."""
    keys = F.json_object_keys(F.col(document))
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in known])))


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def exactly_one(*conds: Column) -> Column:
    total = F.lit(0)
    for c in conds:
        total = total + F.coalesce(c, F.lit(False)).cast("int")
    return total == 1


def decide(df: DataFrame, codes: list[str], table: list[tuple[str, str]], levels: list[str]) -> DataFrame:
    """``df`` with ``level`` and ``code``: the most severe finding among the code columns.

    ``table`` maps codes to levels, ``levels`` goes from most severe to least. Between codes of one level the order of the
    table decides. A code that isn't in the table raises when the result is computed; null is no finding (level ``ok``).
    """
    rank = {code: (levels.index(level), k, level) for k, (code, level) in enumerate(table)}
    entries = [x for code, (a, b, level) in rank.items() for x in (F.lit(code), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(level).alias("level"), F.lit(code).alias("code")))]
    lookup = F.create_map(*entries)
    looked = [
        F.when(F.col(c).isNotNull(), F.when(lookup[F.col(c)].isNotNull(), lookup[F.col(c)]).otherwise(F.raise_error(F.concat(F.lit("unknown code "), F.col(c))).cast("struct<a:int,b:int,level:string,code:string>")))
        for c in codes
    ]
    worst = F.least(*looked) if len(looked) > 1 else looked[0]
    return df.withColumn("level", F.coalesce(worst["level"], F.lit("ok"))).withColumn("code", worst["code"])


def bucket(value: Column, edges: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first edge that ``value`` is above, edges from high to low; null stays null."""
    out = None
    for edge, name in edges:
        out = F.when(value > edge, name) if out is None else out.when(value > edge, name)
    return F.when(value.isNotNull(), out.otherwise(otherwise))


def reject_frozen(changes: DataFrame, versions: DataFrame, key: str, frozen_at: str) -> DataFrame:
    """``changes`` if none of them touches a frozen version; otherwise computing the result raises."""
    frozen = versions.where(F.col(frozen_at).isNotNull()).select(F.col(key).alias("__key")).distinct().withColumn("__frozen", F.lit(True))
    joined = changes.join(frozen, changes[key] == frozen["__key"], "left")
    guard = F.when(F.col("__frozen"), F.raise_error(F.concat(F.lit("frozen: "), F.col(key).cast("string"))).cast(changes.schema[key].dataType)).otherwise(F.col(key))
    return joined.select(*[guard.alias(c) if c == key else F.col(c) for c in changes.columns])


def run_steps(df: DataFrame, steps: list[tuple[str, Column, str]], done: str) -> DataFrame:
    """``df`` with ``outcome`` and ``step``: steps (name, condition, outcome) are tried in order, the first that holds decides.

    A row that no step stops has the outcome ``done`` and the last step's name. A null condition doesn't hold.
    """
    outcome, step = F.lit(done), F.lit(steps[-1][0] if steps else None)
    for name, condition, result in reversed(steps):
        holds = F.coalesce(condition, F.lit(False))
        outcome, step = F.when(holds, F.lit(result)).otherwise(outcome), F.when(holds, F.lit(name)).otherwise(step)
    return df.withColumn("outcome", outcome).withColumn("step", step)
