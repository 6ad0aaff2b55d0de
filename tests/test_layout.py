"""Tables from cell rectangles and outlines of lines against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from veldt.operators import grids, outline, scan

CELLS = "tab string, l double, t double, r double, b double, text string, heads int"
SAMPLE = [(10, 10, 60, 20, "Grade"), (60, 10, 110, 20, "Signs"), (110, 10, 160, 20, "Action"), (10, 20.04, 60, 30, "1"), (60, 20, 110, 30, "none"), (110, 20, 160, 30, "observe"), (10, 30, 60, 40, "2"), (60, 30, 110, 40, "lo­cal \n x"), (110, 30, 160, 40, "treat")]
SPANS = [(10, 10, 60, 20, "A"), (60, 10, 110, 20, "B"), (110, 10, 160, 20, "C"), (10, 20, 110, 30, "wide"), (110, 20, 160, 40, "tall"), (10, 30, 60, 40, "x")]
GROUPED = [(10, 10, 110, 20, "Pulse"), (10, 20, 60, 30, "left"), (60, 20, 110, 30, "right"), (10, 30, 60, 40, "present"), (60, 30, 110, 40, "absent")]
EMPTY = [(10, 10, 60, 20, "A"), (60, 10, 110, 20, ""), (10, 20, 60, 30, ""), (60, 20, 110, 30, None), (10, 30, 60, 40, "x"), (60, 30, 110, 40, "y")]
CLASH = [(10, 10, 60, 20, "a"), (10, 10, 60, 20, "b"), (10, 20, 60, 30, "c")]


def test_grids(spark):
    tables = {"sample": (SAMPLE, 1), "spans": (SPANS, 1), "grouped": (GROUPED, 2), "empty": (EMPTY, 1), "clash": (CLASH, 1), "short": (SAMPLE, 3), "none": ([(10, 10, 60, 20, "only")], 0), "lost": ([(None, 1, 2, 3, "x")], 0), None: (SAMPLE, 1)}
    rows = [(name, *map(lambda v: None if v is None else float(v), c[:4]), c[4], heads) for name, (cells, heads) in tables.items() for c in cells]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows + rows[:9], CELLS).repartition(4)
    found, problems = grids.grid(df, "tab", ("l", "t", "r", "b"), "text", F.col("heads"))
    sample = [("Grade: 1 | Signs: none | Action: observe", 0), ("Grade: 2 | Signs: local x | Action: treat", 1)]
    want = [("sample", *x) for x in sample] + [(None, *x) for x in sample] + [("spans", "A / B: wide | C: tall", 0), ("spans", "A: x | C: tall", 1), ("grouped", "Pulse / left: present | Pulse / right: absent", 0), ("empty", "A: x | y", 1), ("none", "only", 0)]
    assert sorted(((x["table"], x["text"], x["row"]) for x in found.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, problems.collect()), key=str) == sorted([("clash", "two cells overlap", 1, 1), ("short", "no body row is left", None, None), ("lost", "a cell without a place", None, None)], key=str)
    assert grids.grid(df.limit(0), "tab", ("l", "t", "r", "b"), "text")[0].count() == 0


def test_small_tables_are_looked_up_and_large_ones_swept(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    edge = lambda: r.choice([0, 1, 2, 5, 9, 30])
    rows = [(t, edge(), edge(), edge(), edge(), f"x{k}", k) for t, n in (("a", 1), ("b", 12), ("c", 40), (None, 9)) for k in range(n)]
    cells = spark.createDataFrame(rows, "table string, l long, t long, r long, b long, text string, __id long").withColumn("__id", F.xxhash64("table", "__id")).repartition(3)
    cells.write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    found = []
    for few in (0, 10, 1000):
        monkeypatch.setattr(grids, "FEW", few)
        got = grids._spread(cells).select("table", "__id", "c_first", "c_end", "r_first", "r_end")
        found.append(sorted(map(tuple, got.collect()), key=str))
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]
    # few cells a table: one shuffle and no join
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_paths(spark, monkeypatch, hot_rows):
    if hot_rows:
        monkeypatch.setattr(scan, "HOT_ROWS", hot_rows)
    r = random.Random(3)
    docs = {d: [(r.choice([0, 0, 0, None, 1, 2, 3, 9]), f"t{k}" if k % 7 else None) for k in range(n)] for d, n in (("a", 1), ("b", 60), ("c", 9), (None, 12))}
    want = {}
    for d, lines in docs.items():
        stack = []
        for k, (level, title) in enumerate(lines):
            end = None
            if level in (1, 2, 3):
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, title))
                end = next((j - 1 for j in range(k + 1, len(lines)) if lines[j][0] in range(1, level + 1)), len(lines) - 1)
            want[d, k] = ([t for _, t in stack], end)
    df = spark.createDataFrame([(d, k, lv, t) for d, lines in docs.items() for k, (lv, t) in enumerate(lines)], "d string, pos long, level int, title string").repartition(3)
    found = outline.paths(df, "d", "pos", "level", "title", 3)
    assert found.columns == ["d", "pos", "level", "title", "path", "section_end"]
    assert {(x["d"], x["pos"]): (x["path"], x["section_end"]) for x in found.collect()} == want


@pytest.mark.parametrize("seed", range(30))
def test_longest_rising(seed):
    r = random.Random(seed)
    places = r.sample(range(20), r.randint(0, 8))
    best = max((m for m in itertools.product([True, False], repeat=len(places)) if [p for p, k in zip(places, m) if k] == sorted(p for p, k in zip(places, m) if k)), key=lambda m: (sum(m), m), default=())
    assert outline.in_order(places) == list(best)


def test_confirmed_headings(spark):
    lines = [("a", 1, "Intro"), ("a", 2, "End"), ("a", 3, "Middle"), ("a", 4, "Intro"), ("b", 1, "Other"), ("a", 5, None)]
    df = spark.createDataFrame(lines, "d string, pos long, title string")
    confirmed = spark.createDataFrame([("Intro", 1), ("Middle", 2), ("End", 3)], "title string, place long")
    found = outline.against(df, confirmed, "d", "pos", "title", "place")
    want = {("a", "Intro"): "in_order", ("a", "End"): "in_order", ("a", "Middle"): "out_of_order", ("b", "Intro"): "missing", ("b", "Middle"): "missing", ("b", "End"): "missing"}
    assert {(x["d"], x["title"]): x["status"] for x in found.collect()} == want
