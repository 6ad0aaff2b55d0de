"""Suppression of boxes against the greedy loop."""

import random

import pytest

from veldt.operators import boxes

BOX = "id long, g string, l double, t double, r double, b double, score double"


def share(p, q):
    w, h = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
    common = w * h if w > 0 and h > 0 else 0.0
    union = (p[4] - p[2]) * (p[5] - p[3]) + (q[4] - q[2]) * (q[5] - q[3]) - common
    return common / union if union > 0 else 0.0


def plain(rows, most):
    kept = []
    for p in sorted(rows, key=lambda r: (-(r[6] if r[6] is not None else float("-inf")), r[0])):
        if None in p[2:6] or p[4] <= p[2] or p[5] <= p[3] or all(q[1] != p[1] or None in q[2:6] or q[4] <= q[2] or q[5] <= q[3] or share(p, q) <= most for q in kept):
            kept.append(p)
    return sorted(r[0] for r in kept)


@pytest.mark.parametrize("seed,most", [(1, 0.5), (2, 0.3), (3, 0.7)])
def test_against_the_greedy_loop(spark, seed, most):
    r = random.Random(seed)
    rows = []
    for k in range(400):
        if rows and r.random() < 0.6:
            p = r.choice(rows)
            l, t, w, h = (x + r.uniform(-1, 1) * s for x, s in ((p[2], 2), (p[3], 2), (p[4] - p[2], 2), (p[5] - p[3], 2)))
        else:
            l, t, w, h = r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0.3, 5, 20]) * r.uniform(0.5, 1.5), r.choice([0.3, 5, 20])
        rows.append((k, r.choice(["a", "a", None]), l, t, l + w, t + h, r.choice([None, round(r.random(), 1), r.random()])))
    rows = [x if k % 50 else (*x[:2], None, *x[3:]) for k, x in enumerate(rows)]
    df = spark.createDataFrame(rows, BOX).repartition(4)
    found = boxes.suppress_boxes(df, "g", ("l", "t", "r", "b"), "score", "id", most)
    want = plain([x for x in rows if x[2] is not None], most) + [x[0] for x in rows if x[2] is None]
    assert found.columns == df.columns and sorted(x["id"] for x in found.collect()) == sorted(want) and len(want) < 390


def test_one_spot_and_empty(spark):
    """Many boxes on one spot take few rounds and no pairs of them all."""
    rows = [(k, "hot", 0.001 * k, 0.0, 10 + 0.001 * k, 10.0, k / 3000) for k in range(3000)]
    df = spark.createDataFrame(rows, BOX)
    assert [x["id"] for x in boxes.suppress_boxes(df, "g", ("l", "t", "r", "b"), "score", "id").collect()] == plain(rows, 0.5) == [2999]
    assert boxes.suppress_boxes(df.limit(0), "g", ("l", "t", "r", "b"), "score", "id").count() == 0


def test_groups_of_few_boxes_take_no_rounds(spark, monkeypatch):
    """A table of small groups is decided in one pass; a group above the limit beside them, by rounds, has the same rows."""
    r = random.Random(4)
    rows = []
    for k in range(3000):
        l, t = r.uniform(0, 30), r.uniform(0, 30)
        rows.append((k, r.choice(["a", "b", "c", None, str(k % 60)]), l, t, l + r.choice([5, 8, 20]), t + r.choice([5, 8, 20]), r.choice([None, round(r.random(), 1)])))
    df = spark.createDataFrame(rows, BOX).repartition(4)
    tables, own = [], boxes.written
    monkeypatch.setattr(boxes, "written", lambda frame, name: tables.append(name) or own(frame, name))
    ids = lambda: sorted(x["id"] for x in boxes.suppress_boxes(df, "g", ("l", "t", "r", "b"), "score", "id").collect())
    found = ids()
    assert "cells" not in tables and found == plain(rows, 0.5)
    monkeypatch.setattr(boxes, "LOCAL_ROWS", 100)
    assert ids() == found and "cells" in tables
