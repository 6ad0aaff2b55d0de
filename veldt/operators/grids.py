"""Cell rectangles of tables to grids, headers and row texts: sweeps, joins and groupings, no table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators import scan
from veldt.operators.shared import written

#: Cells of a table that are brought together at most.
FEW = 512


def _covered(cells: DataFrame, table: str, start: str, end: str, name: str) -> DataFrame:
    """``cells`` with (name)_first and (name)_end: which of the table's distinct ``start`` edges lie from a cell's start up to before its end.

    A sweep along the edges: each cell leaves a mark at its start and its end, and a running sum counts the edges before each mark.
    """
    edges = cells.select(table, F.col(start).alias("__pos")).distinct().select(table, "__pos", F.lit(1).alias("__edge"), F.lit(None).cast("long").alias("__id"), F.lit(False).alias("__is_end"))
    # a cell is at least as wide as the raster
    marks = cells.select(table, F.explode(F.array(F.struct(F.col(start).alias("p"), F.lit(False).alias("e")), F.struct(F.greatest(F.col(end), F.col(start) + 1).alias("p"), F.lit(True).alias("e")))).alias("m"), "__id")
    swept = scan.totals(edges.unionByName(marks.select(table, F.col("m.p").alias("__pos"), F.lit(0).alias("__edge"), "__id", F.col("m.e").alias("__is_end"))), [table], "__pos", {"__before": ("sum", F.col("__edge"))}, True)
    both = swept.where("__edge = 0").groupBy("__id").agg(*[F.max(F.when(F.col("__is_end") == is_end, F.coalesce("__before", F.lit(0)))).cast("int").alias(f"{name}_{part}") for is_end, part in ((False, "first"), (True, "end"))])
    return cells.join(both, "__id")


def _looked_up(cells: DataFrame) -> DataFrame:
    """``cells`` with what ``_covered`` gives of both axes, for tables of few cells: a table's cells and edges are one row for a moment."""
    own = [c for c in cells.columns if c != "table"]
    edges = {name: F.array_sort(F.collect_set(start)).alias(f"__{name}") for start, name in (("l", "c"), ("t", "r"))}
    each = cells.groupBy("table").agg(F.collect_list(F.struct(*own)).alias("__cells"), *edges.values()).select("table", "__c", "__r", F.explode("__cells").alias("x")).select("table", "__c", "__r", "x.*")
    before = lambda name, at: F.size(F.filter(f"__{name}", lambda e: e < at))
    spans = {"c_first": before("c", F.col("l")), "c_end": before("c", F.greatest("r", F.col("l") + 1)), "r_first": before("r", F.col("t")), "r_end": before("r", F.greatest("b", F.col("t") + 1))}
    return each.select(*cells.columns, *[c.cast("int").alias(name) for name, c in spans.items()])


def _spread(cells: DataFrame) -> DataFrame:
    """``cells`` with the columns and rows of their table that they cover: tables of up to FEW cells are looked at one by one, larger ones are swept."""
    sweep = lambda some: _covered(_covered(some, "table", "l", "r", "c"), "table", "t", "b", "r")
    large = written(cells.groupBy("table").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select("table"), "large")
    if large.isEmpty():
        return _looked_up(cells)
    return _looked_up(scan.meet(cells, large, ["table"], "left_anti")).unionByName(sweep(scan.meet(cells, large, ["table"], "left_semi")))


def clean(text: Column) -> Column:
    """A cell's text without soft hyphens, with single blanks, trimmed. See ``functions.text.nfc`` for normal form C."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "­", ""), r"(?U)\s+", " "))


def grid(cells: DataFrame, table: str, box: tuple[str, str, str, str], text: str, headers: Column | int = 1, raster: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of tables given by cells with a ``box`` of left, top, right and bottom.

    Coordinates are rounded to ``raster``. Distinct lefts are a table's columns and distinct tops its rows; a cell covers those from its own edge
    to before its far one. The first ``headers`` rows (a number, or a column that is the same for all cells of a table) name the columns: names of one
    column are joined by `` / ``, equal neighbours once. In the body a cell of several columns is written once, at the first, and one of several rows in each.
    Rows: (table, row, n_cells, text), ``row`` counting body rows from 0, and ``text`` reading ``header: value | ...`` with the headers of all columns a value
    covers; rows without text are left out. Problems: (table, problem, row, column) where two cells with different texts
    meet (counting from 1) or where no body row is left. Any order of cells gives the same. Null texts are empty; cells with a null coordinate are a problem.
    """
    left, top, right, bottom = box
    whole = lambda c: F.round(F.col(c).cast("double") / raster).cast("long")
    n = headers if isinstance(headers, Column) else F.lit(headers)
    named = cells.select(F.col(table).alias("table"), *[whole(c).alias(k) for c, k in zip(box, ("l", "t", "r", "b"))], clean(F.col(text)).alias("text"), n.cast("int").alias("headers"))
    fine = F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("r").isNotNull() & F.col("b").isNotNull()
    nowhere = named.where(~fine).select("table", F.lit("a cell without a place").alias("problem"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("column")).distinct()
    # numbered in files, so that every later step sees the same numbers
    placed = written(named.where(fine).distinct().withColumn("__id", F.monotonically_increasing_id()), "cells")
    spread = written(_spread(placed), "covered")
    sizes = spread.groupBy("table").agg(F.max("r_first").alias("last"), F.max("headers").alias("headers"))
    short = sizes.where((F.col("headers") < 0) | (F.col("headers") > F.col("last"))).select("table", F.lit("no body row is left").alias("problem"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("column"))
    fields = spread.withColumn("row", F.explode(F.sequence("r_first", F.col("r_end") - 1))).withColumn("column", F.explode(F.sequence("c_first", F.col("c_end") - 1)))
    body, first = F.col("row") >= F.col("headers"), F.col("column") == F.col("c_first")
    value = F.when(body & ~first, "").otherwise(F.col("text"))
    order = F.when(body & (F.col("text") != ""), F.struct("t", "l", "text"))
    width = F.when(first, F.col("c_end") - F.col("c_first")).otherwise(0)
    told = fields.select("table", "row", "column", "headers", F.when(value != "", value).alias("v"), order.alias("o"), width.alias("w"))
    at = written(told.groupBy("table", "row", "column").agg(F.max("headers").alias("headers"), F.min("v").alias("low"), F.max("v").alias("v"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("o"))).alias("f"), F.max_by("w", "o").alias("w")), "grid")
    clash = at.where("low <> v").select("table", F.lit("two cells overlap").alias("problem"), (F.col("row") + 1).cast("int").alias("row"), (F.col("column") + 1).cast("int").alias("column"))
    heads = at.where(F.col("row") < F.col("headers")).where("v IS NOT NULL").groupBy("table", "column").agg(F.array_sort(F.collect_list(F.struct("row", "v"))).alias("h"))
    # neighbours that are equal count once
    parts = F.filter(F.col("h"), lambda x, i: (i == 0) | (x["v"] != F.col("h")[F.greatest(i - 1, F.lit(0))]["v"]))
    heads = heads.select("table", F.col("column").alias("c"), F.array_join(F.transform(parts, lambda x: x["v"]), " / ").alias("header"))
    cells_of = at.where(F.col("row") >= F.col("headers")).where("v IS NOT NULL AND coalesce(w, 1) > 0").withColumn("c", F.explode(F.sequence("column", F.col("column") + F.coalesce("w", F.lit(1)) - 1)))
    met = scan.meet(cells_of, heads, ["table", "c"]).groupBy("table", "row", "column").agg(F.max("v").alias("v"), F.min("headers").alias("headers"), F.array_sort(F.collect_list(F.struct("c", "header"))).alias("h"))
    header = F.array_join(F.array_distinct(F.filter(F.transform("h", lambda x: x["header"]), lambda x: x.isNotNull())), " / ")
    pair = F.when(header == "", F.col("v")).otherwise(F.concat(header, F.lit(": "), F.col("v")))
    lines = met.groupBy("table", "row").agg(F.min("headers").alias("headers"), F.array_sort(F.collect_list(F.struct("column", pair.alias("p")))).alias("p"))
    problems = clash.unionByName(short).unionByName(nowhere)
    wrong = problems.select(F.col("table").alias("bad")).distinct()
    good = lines.join(wrong, F.expr("table <=> bad"), "left_anti")
    rows = good.select("table", (F.col("row") - F.col("headers")).cast("int").alias("row"), F.size("p").alias("n_cells"), F.array_join(F.transform("p", lambda x: x["p"]), " | ").alias("text"))
    return rows, problems
