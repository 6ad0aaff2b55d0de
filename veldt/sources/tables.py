"""Sources: tables with declared schemas, CSV, JSON lines, names as data, parameters as rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators.keyed import latest_per_key


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table. With ``schema`` (DDL) a table of other columns or types raises before anything is computed."""
    df = spark.read.parquet(path)
    if schema is not None:
        want = {(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], schema).schema}
        have = {(f.name, f.dataType.simpleString()) for f in df.schema}
        if want != have:
            raise ValueError(f"{path}: expected {sorted(want - have)}, found {sorted(have - want)}")
    return df


def schema_hash(df: DataFrame) -> str:
    """Digest of names and types, in order."""
    return hashlib.sha256(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema).encode()).hexdigest()


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",", empty_as_null: bool = True) -> DataFrame:
    """A CSV with a header; a row that doesn't fit the schema raises."""
    return spark.read.csv(path, schema=schema, header=True, sep=separator, mode="FAILFAST", nullValue="" if empty_as_null else None)


def read_jsonl_latest(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON lines; of the rows of a key the one with the largest ``order`` counts. A line that isn't JSON raises."""
    return latest_per_key(spark.read.json(path, schema=schema, mode="FAILFAST"), key, [order])


def read_config(spark: SparkSession, path: str, schema: str, section: str | None = None) -> DataFrame:
    """Rows of a small YAML or JSON file: its list, or the list under ``section``, each entry beside the file's other simple values.

    Missing values are null; an entry with a name that the schema lacks raises. YAML needs the yaml package; JSON doesn't.
    The file is configuration, read whole by the driver through Spark's file systems.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml

        content = yaml.safe_load(text)
    except ImportError:
        content = json.loads(text)
    names = spark.createDataFrame([], schema).columns
    shared = {k: v for k, v in content.items() if not isinstance(v, list | dict)} if isinstance(content, dict) else {}
    entries = content if section is None else content[section]
    rows = [{**{k: v for k, v in shared.items() if k in names}, **entry} for entry in entries]
    unknown = sorted({k for row in rows for k in row} - set(names))
    if unknown:
        raise ValueError(f"{path}: unknown names {unknown}")
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with ``parsed`` (a struct of ``schema``) and ``problem``: null, ``empty`` or ``malformed``. No row is dropped."""
    kind = f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schema.split(','))},_bad:string>"
    parsed = F.from_json(F.col(column), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("parsed", parsed)
    blank = F.col(column).isNull() | (F.trim(F.col(column)) == "")
    return out.withColumn("problem", F.when(blank, "empty").when(F.col("parsed").isNull() | F.col("parsed._bad").isNotNull(), "malformed"))


def json_entries(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, name, value): the entries of a JSON object as text. Other JSON has none."""
    return df.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("name", "value"))


def parse_names(df: DataFrame, column: str, pattern: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``fields`` taken from a name by the groups of ``pattern``, rows whose name doesn't match)."""
    whole = F.col(column).rlike(f"^(?:{pattern})$")
    good = df.where(whole).select("*", *[F.regexp_extract(column, f"^(?:{pattern})$", k + 1).alias(f) for k, f in enumerate(fields)])
    return good, df.where(~F.coalesce(whole, F.lit(False))).withColumn("reason", F.lit("name doesn't match"))


def parameter_rows(spark: SparkSession, columns: dict[str, Iterable], schema: str) -> DataFrame:
    """Parallel parameter lists as a table."""
    lists = [list(v) for v in columns.values()]
    if len({len(x) for x in lists}) > 1:
        raise ValueError("lists of different lengths")
    return spark.createDataFrame(list(zip(*lists)), schema)


def disagreements(first: DataFrame, second: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows (key, a, b): cells that two readings of a grid have differently, or that only one has."""
    a, b = first.select(*key, F.col(value).alias("a")), second.select(*key, F.col(value).alias("b"))
    return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def optional(df: DataFrame, **equal) -> DataFrame:
    """``df`` filtered by the parameters that are not None."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def filled(value: Column, default: str = "not_recorded") -> Column:
    return F.coalesce(value, F.lit(default))


def contains_entries(document: Column, entries: dict[str, str]) -> Column:
    """Whether a JSON object has all ``entries``; values compare as text. No entries are in every object."""
    m = F.from_json(document, "map<string,string>")
    out = m.isNotNull()
    for k, v in entries.items():
        out = out & F.coalesce(F.try_element_at(m, F.lit(k)) == v, F.lit(False))
    return F.coalesce(out, F.lit(False))
