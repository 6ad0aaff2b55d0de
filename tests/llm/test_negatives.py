"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, every=10):
    kept = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b is not a)
        for p, i, _ in [s for s in scored if s[2] == a[1]][:5]:
            hard = [s for s in scored if s[2] != a[1] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a[0], i, n + 1, s[1], -p, -s[0]) for n, s in enumerate(hard)]
    return sorted(out)


def mined(df, every=10):
    return sorted(map(tuple, hn.mine(df, F.col("id") % every == 0).collect()))


def made(seed, n=300, labels=4, size=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, size))
    rows = [(k, (centres[k % 6] * r.choice([0, 1, 2]) + r.normal(scale=r.choice([0.0, 0.3, 2]), size=size)).astype(np.float32).tolist(), int(r.integers(labels))) for k in range(n)]
    first = rows[1][1]
    rows += [(n + k, first, k % 2) for k in range(40)] + [(10, rows[10][1], rows[10][2])] * 3
    return rows + [(None, first, 1), (900, None, 1), (910, first, None), (920, [float("nan")] + first[1:], 1), (930, [None] + first[1:], 1), (940, first[:3], 1), (950, [], 1), (960, [0.0] * size, 2), (970, [-x for x in first], 2)]


@pytest.mark.parametrize("seed,block,leaf", [(1, 4096, 64), (2, 32, 4), (3, 50, 1)])
def test_against_all_pairs(spark, monkeypatch, seed, block, leaf):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("BATCH", 7), ("TILE", 2)):
        monkeypatch.setattr(hn, name, value)
    rows = made(seed)
    df = spark.createDataFrame(rows, ROWS).withColumn("name", F.lit("clash")).repartition(5)
    assert mined(df) == plain(rows)


def test_huge_components_and_empty_tables(spark):
    rows = [(k, [float(2 ** (k % 23)), 3.0e6, 1.0], k % 3) for k in range(60)]
    assert mined(spark.createDataFrame(rows, ROWS)) == plain(rows)
    assert mined(spark.createDataFrame([], ROWS)) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1)], ROWS)) == []


def test_far_leaves_are_passed():
    """On data with structure most leaves lie outside the annulus or behind the k-th best."""
    r = np.random.default_rng(4)
    x = np.floor(256 * (np.repeat(r.normal(size=(16, 8)), 64, 0) + r.normal(scale=0.01, size=(1024, 8))))
    longest = float(np.square(x).sum(1).max())
    seen = []

    class Counted(hn.Search):
        def _take(self, who, *rest):
            seen.append(len(who) * len(rest[0]))
            super()._take(who, *rest)

    q = x[::100]
    ends = np.full((len(q), 1), hn.LOWEST), np.full((len(q), 1), hn.HIGHEST)
    found = Counted(np.arange(-len(q), 0), np.zeros(len(q)), q, *ends, True, 5, longest)
    found.visit(hn.build(x, longest, 16), x, np.arange(1024), np.arange(1024), np.zeros(1024))
    best = np.sort(q @ x.T, axis=1)[:, : -6 : -1]
    assert (found.scores[:, 0] == best).all() and sum(seen) < 0.5 * len(q) * 1024
