"""Leases and retries with timers against a fold over the same times, in one batch and in many."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veldt.streaming import events as S
from veldt.streaming import timed

KINDS = ["lease", "lease", "lease", "failed", "accepted", "rejected", "deferred", "complete", "superseded", None, "hello"]


def log(spark, rows, schema, parts):
    """Files in order of time."""
    home = f"/tmp/checkpoints/veldt-timed-{uuid.uuid4().hex}"
    rows = sorted(rows, key=lambda r: r[1])
    for k in range(parts):
        cut = rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(home)
    return home


def plain_leases(rows, end):
    out = {}
    for key, at, kind in sorted(rows, key=lambda r: r[1]):
        status, expires, attempts, expired = out.get(key, ("pending", None, 0, 0))
        if expires is not None and expires <= at:
            status, expires, expired = "pending", None, expired + 1
        if kind == "lease" and status == "pending":
            status, expires, attempts = "in_flight", at + 120_000, attempts + 1
        elif kind == "failed" and status == "in_flight":
            status, expires = "pending", None
        elif kind == "accepted" and status in ("pending", "in_flight"):
            status, expires = kind, None
        elif kind == "deferred" and status in ("pending", "in_flight", "accepted"):
            status, expires = kind, None
        elif kind in ("rejected", "complete") or (kind == "superseded" and status != "complete"):
            status, expires = kind, None
        out[key] = status, expires, attempts, expired
    return {k: ("pending", n, x + 1) if e is not None and e <= end else (s, n, x) for k, (s, e, n, x) in out.items()}


@pytest.mark.parametrize("parts", [1, 7])
def test_leases(spark, parts):
    r = random.Random(parts)
    rows = [(r.randrange(40), at, r.choice(KINDS if r.random() < 0.2 else ["lease", "failed"])) for at in r.sample(range(3_000_000), 600)]
    rows += [(1000, 2_700_000, "lease"), (1001, 2_999_999, "lease"), (1002, 3_000_000, "failed")]
    stream = S.file_stream(spark, log(spark, rows, "item long, at long, kind string", parts))
    found = S.run_to_end(timed.leases(stream, "item", "at", "kind"), "update")
    best = found.groupBy("item").agg(F.max_by(F.struct("status", "attempts", "expired"), F.struct("at_ms", "batch")).alias("s")).select("item", "s.*")
    want = plain_leases(rows, 3_000_000)
    assert {x["item"]: tuple(x)[1:] for x in best.collect()} == want
    assert want[1000][0] == "pending" and want[1001][0] == "in_flight" and max(x for _, _, x in want.values()) > 3


@pytest.mark.parametrize("parts", [1, 5])
def test_retries(spark, parts):
    r = random.Random(parts)
    rows = [(r.randrange(9), at, k, r.randrange(5)) for k, at in enumerate(r.sample(range(2_000_000), 300))] + [(1, 5000, 900 + k, 2) for k in range(5)]
    end = max(x[1] for x in rows)
    stream = S.file_stream(spark, log(spark, rows, "grp long, at long, id long, fails int", parts))
    found = S.run_to_end(timed.retries(stream, "grp", "id", "at", "fails", lambda fails, attempts: attempts >= fails), "append")
    want = []
    for grp, at, k, fails in rows:
        tried = min(fails, 2)
        due = at + (0, 30_000, 330_000)[tried]
        if due <= end:
            want.append((grp, k, "done" if fails < 3 else "dead", tried + 1, due))
    assert sorted(tuple(x)[:5] for x in found.collect()) == sorted(want) and any(w[2] == "dead" for w in want) and len(want) < len(rows)


def test_a_key_has_one_timer():
    """Messages that wait for many times have one timer, and all that are due by the watermark are tried when it fires."""

    class Value:
        row = None
        exists = lambda self: self.row is not None
        get = lambda self: self.row

        def update(self, row):
            self.row = row

        def clear(self):
            self.row = None

    class Handle:
        def __init__(self):
            self.timers, self.set = set(), 0

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            self.timers.add(at)
            self.set += 1

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Now:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at
            self.getExpiryTimeInMs = lambda: 31_000

    work, handle = timed.Retries("k", "id", "at", "fails", lambda fails, attempts: attempts >= fails, (30, 300)), Handle()
    work.init(handle)
    rows = pd.DataFrame({"id": range(50), "at": [1000 * (k + 1) for k in range(50)], "fails": [k % 4 for k in range(50)]})
    found = list(work.handleInputRows((7,), iter([rows]), Now(0)))
    assert handle.timers == {32_000} and handle.set == 1
    found += list(work.handleExpiredTimer((7,), Now(70_000), Now(0)))
    # the first that the watermark has not reached
    assert handle.timers == {32_000, 72_000}
    handle.timers.discard(32_000)
    found += list(work.handleExpiredTimer((7,), Now(1_000_000), Now(0)))
    done = {x.id: (x.outcome, x.attempts, x.at_ms) for part in found for x in part.itertuples()}
    assert done == {k: ("done" if k % 4 < 3 else "dead", min(k % 4, 2) + 1, 1000 * (k + 1) + (0, 30_000, 330_000, 330_000)[k % 4]) for k in range(50)}
