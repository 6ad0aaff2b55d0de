"""Annotation of statements by patterns that are data: clauses, the fields named in them, polarity, thresholds, phrases, confirmed mappings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Patterns (without case) that say what a statement is about.

    ``openers``: a statement that starts so opens with a clause; ``start``: a clause may start anywhere so; ``ends``: any of these ends a
    clause; ``fields``: name of a field to its terms; ``qualifier``: a word that, up to ``within`` words ahead of a term, keeps it from
    counting; ``prohibit``: the main clause starts so in a prohibition; ``prohibit_anywhere``: or this stands somewhere.
    """

    openers: list[str]
    start: str
    ends: list[str]
    fields: dict[str, list[str]]
    qualifier: str
    prohibit: list[str] = field(default_factory=list)
    prohibit_anywhere: str = ""
    within: int = 5


def _any(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")" if patterns else r"(?!)"


def clauses(text: Column, start: str, ends: list[str]) -> Column:
    """Clauses of a text in order: each runs from a match of ``start`` up to the first of ``ends``, or to the end of the text.

    The next clause is looked for behind the one before. A null text has null.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?is)(?={start})(?:(?!{_any(ends)}).)+"), F.lit(0))


def opening_clause(text: Column, openers: list[str], ends: list[str]) -> Column:
    """The clause that the text opens with, or null."""
    found = F.regexp_extract(text, rf"(?is)\A(?={_any(openers)})(?:(?!{_any(ends)}).)+", 0)
    return F.when(found != "", found)


def fields_named(parts: Column, fields: dict[str, list[str]]) -> Column:
    """Names of the fields with a term in any of the parts, in the order of their names."""
    return _names(parts, {name: lambda p, t=_any(terms): p.rlike(f"(?i){t}") for name, terms in fields.items()})


def _names(parts: Column, tests: dict[str, Callable[[Column], Column]]) -> Column:
    def holds(test: Callable[[Column], Column]) -> Column:
        return F.exists(parts, lambda p: test(p))

    return F.array_compact(F.array(*[F.when(holds(test), F.lit(name)) for name, test in sorted(tests.items())]))


def fields_gating(parts: Column, fields: dict[str, list[str]], qualifier: str, within: int = 5) -> Column:
    """As ``fields_named``, but terms up to ``within`` words behind a qualifier in the same part don't count."""
    def free(terms: str) -> Callable[[Column], Column]:
        # from a qualifier to the last term it reaches; what then is left stands by itself
        reach = rf"(?:\W+\w+){{0,{within}}}?\W+{terms}"
        return lambda p: F.regexp_replace(p, rf"(?i){qualifier}{reach}(?:{reach})*", " ").rlike(f"(?i){terms}")

    return _names(parts, {name: free(_any(terms)) for name, terms in fields.items()})


def annotate(df: DataFrame, text: str, rules: Rules) -> DataFrame:
    """``df`` with ``opening``, ``clauses``, ``required``, ``mentioned``, ``polarity`` and ``flags``.

    A field is required if one of its terms stands, unqualified, in the opening clause or another clause; fields only named
    elsewhere or behind a qualifier are mentioned. Polarity is PROHIBIT where the text behind the opening clause starts so or a
    prohibition stands anywhere, else RECOMMEND. Flags tell what a reader should look at. A null text has no clauses or fields.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("opening", opening_clause(body, rules.openers, rules.ends)).withColumn("clauses", clauses(body, rules.start, rules.ends))
    spans = F.concat(F.when(F.col("opening").isNotNull(), F.array("opening")).otherwise(F.array().cast("array<string>")), F.col("clauses"))
    df = df.withColumn("__spans", spans).withColumn("required", fields_gating(F.col("__spans"), rules.fields, rules.qualifier, rules.within))
    df = df.withColumn("mentioned", F.array_except(fields_named(F.array(body), rules.fields), "required"))
    main = F.regexp_replace(F.substr(body, F.coalesce(F.length("opening"), F.lit(0)) + 1), "^[,: ]+", "")
    no = main.rlike(f"(?is)^{_any(rules.prohibit)}") if rules.prohibit else F.lit(False)
    if rules.prohibit_anywhere:
        no = no | body.rlike(f"(?i){rules.prohibit_anywhere}")
    df = df.withColumn("polarity", F.when(no, "PROHIBIT").otherwise("RECOMMEND"))
    qualified = F.array_except(fields_named(F.col("__spans"), rules.fields), "required")
    flags = F.array_compact(
        F.array(
            F.when(F.length("opening") == F.length(body), F.lit("opening clause runs to the end")),
            F.when(F.size("__spans") == 0, F.lit("no clause")),
            F.when(F.size(qualified) > 0, F.lit("field behind a qualifier does not count")),
        )
    )
    return df.withColumn("flags", flags).drop("__spans")


def difference_report(df: DataFrame, difference: str, a: str, b: str, rules: Rules) -> DataFrame:
    """``df`` with ``touches_clause`` and ``touches_number`` of a word difference (only_a, only_b) of the texts ``a`` and ``b``.

    A number is touched if a differing word holds a digit, a clause if one of them stands in a clause of its own text.
    """
    def touched(text: str, only: str) -> Column:
        words = F.regexp_extract_all(F.lower(F.array_join(clauses(F.coalesce(F.col(text), F.lit("")), rules.start, rules.ends), " ")), F.lit(r"([\p{L}\p{N}_]+)"))
        return F.arrays_overlap(words, F.col(f"{difference}.{only}"))

    words = F.concat(f"{difference}.only_a", f"{difference}.only_b")
    return df.withColumn("touches_clause", F.coalesce(touched(a, "only_a") | touched(b, "only_b"), F.lit(False))).withColumn("touches_number", F.exists(words, lambda w: w.rlike(r"\d")))


def locate(thresholds: DataFrame, texts: DataFrame, key: str, token: str, value: str, text: str) -> DataFrame:
    """``thresholds`` with ``quoted`` (the sentence around the token) and ``problem``: null, or why the token can't be quoted.

    Each threshold names a text by ``key`` and a token that must stand there once and carry ``value``. Problems: ``no text``,
    ``found n times``, ``other value``.
    """
    side = texts.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    joined = thresholds.join(side, thresholds[key] == side["__key"], "left")
    places = F.size(F.split("__text", F.concat(F.lit(r"\Q"), F.col(token), F.lit(r"\E")), -1)) - 1
    before = F.expr(f"substring_index(__text, `{token}`, 1)")
    after = F.substr("__text", F.length(before) + F.length(token) + 1)
    cut = F.split(after, r"\. ", 2)
    sentence = F.concat(F.element_at(F.split(before, r"\. ", -1), -1), F.col(token), F.get(cut, F.lit(0)), F.when(F.size(cut) > 1, F.lit(".")).otherwise(F.lit("")))
    number = F.regexp_extract(token, r"\d+(?:\.\d+)?", 0).cast("double")
    problem = (
        F.when(F.col("__text").isNull(), F.lit("no text"))
        .when(places != 1, F.concat(F.lit("found "), places.cast("string"), F.lit(" times")))
        .when(~F.coalesce(number == F.col(value).cast("double"), F.lit(False)), F.lit("other value"))
    )
    return joined.select(*thresholds.columns, F.when(problem.isNull(), F.trim(sentence)).alias("quoted"), problem.alias("problem"))


def phrase(slot: Column, phrases: dict[str, str], name: str) -> Column:
    """The phrase of a slot's value; a value outside the closed vocabulary, or null, raises when the result is computed."""
    found = F.lit(None).cast("string")
    for value, said in phrases.items():
        found = F.when(slot == value, F.lit(said)).otherwise(found)
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"no phrase for {name} = "), F.coalesce(slot.cast("string"), F.lit("null")))).cast("string"))


def summary(slots: dict[str, dict[str, str]], lead: str) -> Column:
    """One line of the phrases of several slots in order, such as ``lead: phrase; phrase.``"""
    return F.concat(F.lit(f"{lead}: "), F.concat_ws("; ", *[phrase(F.col(name), phrases, name) for name, phrases in slots.items()]), F.lit("."))


def confirmed(mapping: DataFrame, status: str = "status") -> DataFrame:
    """``mapping`` if every row is confirmed; a row with another status raises when the result is computed."""
    seen = F.when(F.col(status).eqNullSafe("confirmed"), F.col(status)).otherwise(F.raise_error(F.concat(F.lit("mapping is not confirmed: "), F.coalesce(F.col(status), F.lit("null")))).cast("string"))
    return mapping.withColumn(status, seen)


def mapping_problems(mapping: DataFrame, names: DataFrame, name: str, target: str, excluded: DataFrame | None = None) -> DataFrame:
    """Rows (name, n_targets, problem) of names that don't resolve to exactly one target: ``missing``, ``several`` or ``unknown``.

    ``mapping`` has (name, target); ``names`` lists what must resolve; names in ``excluded`` need no target.
    """
    counts = mapping.groupBy(name).agg(F.count_distinct(target).alias("n_targets"))
    wanted = names.select(F.col(name).alias("__name")).distinct()
    if excluded is not None:
        wanted = wanted.join(excluded.select(F.col(name).alias("__name")).distinct(), "__name", "left_anti")
    joined = wanted.join(counts, F.col("__name") == F.col(name), "full_outer")
    problem = F.when(F.col("__name").isNull(), "unknown").when(F.col(name).isNull(), "missing").when(F.col("n_targets") > 1, "several")
    out = joined.select(F.coalesce("__name", name).alias(name), F.coalesce("n_targets", F.lit(0)).cast("long").alias("n_targets"), problem.alias("problem"))
    return out.where("problem IS NOT NULL")
