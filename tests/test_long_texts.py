"""Text functions on very long texts, and their fast forms against the plain rules."""

import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldt.functions import text


def timed(df):
    began = time.perf_counter()
    row = df.first()
    took = time.perf_counter() - began
    print(round(took, 1))
    assert took < 15
    return row


def plain_join(lines):
    if any(x is None for x in lines):
        return None
    s = ""
    for x in lines:
        if s == "":
            s = x
        elif re.search(r"[a-zé]-$", s) and re.match(r"[a-zé]", x):
            s = s[:-1] + x
        else:
            s = f"{s} {x}"
    return s


def test_joined_lines(spark):
    r = random.Random(1)
    parts = ["", "a-", "b", "-", "é-", "C-", "word", "end-", "next line", "Next", " "]
    rows = [(k, [r.choice(parts) for _ in range(r.randint(0, 7))]) for k in range(500)] + [(900, [None, "a"]), (901, ["a", None, "b"]), (902, ["", "", "a-", "b"])]
    df = spark.createDataFrame(rows, "k int, lines array<string>")
    assert {x["k"]: x["s"] for x in df.select("k", text.joined_lines(F.col("lines")).alias("s")).collect()} == {k: plain_join(v) for k, v in rows}


@pytest.fixture(scope="module")
def warm(spark):
    """Code is compiled before the clock runs."""
    spark.range(1).select(text.scrub(F.lit("a@b.c MRN: 12345"))[0], F.size(text.sentences(F.lit("A. B"))), text.joined_lines(F.array(F.lit("a-"), F.lit("b")))).collect()


def test_long_texts_take_linear_time(spark, warm):
    lines = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda k: F.concat(F.lit("line "), k.cast("string"), F.lit("-"))).alias("l"))
    assert timed(lines.select(F.length(text.joined_lines(F.col("l")))))[0] == sum(len(f"line {k}-") for k in range(1, 100_001)) + 99_999
    blanks = spark.range(1).select(F.concat(F.lit("End."), F.repeat(F.lit(" "), F.lit(1_000_000)), F.lit("Next one.")).alias("t"))
    assert timed(blanks.select(text.sentences(F.col("t"))))[0] == ["End.", "Next one."]
    assert timed(text.chunked(blanks, "t", 1, 3).select(F.size("pieces")))[0] == 1
    word = spark.range(1).select(F.concat(F.lit("MRN"), F.repeat(F.lit(" "), F.lit(100_000)), F.repeat(F.lit("a"), F.lit(1_000_000)), F.lit(" me@x.org")).alias("t"))
    assert timed(word.select(F.right(text.scrub(F.col("t"))[0], F.lit(16))))[0] == " [email removed]"


def test_fast_rules_match_the_plain_ones(spark):
    r = random.Random(2)
    parts = ["a", "b.c", "@", ".", "-", "+", " ", "x@y.z", "MRN", "ID", ":", "#", "12", "3456", "Reg No", "\t", "/", "é", "Clinic  No."]
    rows = [("".join(r.choice(parts) for _ in range(r.randint(1, 14))),) for _ in range(4000)]
    df = spark.createDataFrame(rows, "t string")
    for plain, fast in text.LINEAR.items():
        assert plain in {p for _, _, p in text.SCRUB}
        assert df.where(F.regexp_replace("t", plain, "<>") != F.regexp_replace("t", fast, "<>")).count() == 0
        assert df.where(F.col("t").rlike(plain)).count() > 50


def test_differences_of_a_batch_are_not_held_as_python_objects():
    texts = [" ".join(f"w{k * j % 97}" for j in range(40)) for k in range(4000)]
    a, b = pa.array([*texts, None, "x", ""]), pa.array([*texts[1:], "a b", "b", None, ""])
    tracemalloc.start()
    found, alike = text.word_difference.func(a, b), text.similarity.func(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(alike) == len(a)
    assert peak < 8_000_000
    assert found.slice(4000).to_pylist() == [{"only_a": [], "only_b": ["b"]}, {"only_a": ["x"], "only_b": []}, {"only_a": [], "only_b": []}]
    assert alike.slice(4000).to_pylist() == [None, None, 1.0]
    assert len(text.word_difference.func(a[:0], b[:0])) == 0 == len(text.similarity.func(a[:0], b[:0]))


def plain_cuts(tokens, above, low, high):
    """The cost of each cut as (above the limit, below, pieces, squares); of equal costs the last way counts."""
    n, middle = len(tokens), (low + high) // 2
    best = [((0, 0, 0, 0), 0)] + [None] * n
    for i in range(n):
        size = above
        for j in range(i + 1, n + 1):
            size += tokens[j - 1]
            if j > i + 1 and size > high:
                break
            new = tuple(map(sum, zip(best[i][0], (size > high, size < low and not (i == 0 and j == n), 1, (size - middle) ** 2))))
            if best[j] is None or new <= best[j][0]:
                best[j] = new, i
    out, at = [], n
    while at:
        out.append(at)
        at = best[at][1]
    return out[::-1]


def test_cuts_are_the_plain_ones_at_a_few_operations_each():
    r = random.Random(4)
    for _ in range(500):
        low = r.choice([0, 1, 5, 40])
        high = low + r.choice([0, 1, 7, 60])
        tokens, above = [r.randrange(r.choice([2, 9, 70])) for _ in range(r.randrange(40))], r.choice([0, 0, 3, high, high + 2])
        assert text.best_cuts(tokens, above, low, high) == plain_cuts(tokens, above, low, high)
    tokens = [r.randrange(1, 6) for _ in range(4000)]
    took = []
    for run in (text.best_cuts, plain_cuts):
        began = time.process_time()
        found = run(tokens, 0, 250, 400)
        took.append((time.process_time() - began, found))
    assert took[0][1] == took[1][1]
    assert took[0][0] < took[1][0] / 4
