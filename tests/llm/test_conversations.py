"""Conversation repair against all edits of short conversations, and slices against whole ones."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veldt.llm import conversation_repair as cr

TURNS = "conv_id long, turn long, role string, text string"
ROLE = {"u": "user", "a": "assistant"}


def plain(rows):
    """Cheapest edits by a search over all of them in order of (cost, audit); rows of one conversation, damaged and in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, shape, lines = heapq.heappop(heap)
        state = (at, "" if not shape else "s" if shape == "s" else shape[-1])
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            break
        if (at, audit, state) in done or not re.fullmatch("s?(ua)*u?", shape):
            continue
        done.add((at, audit, state))
        for r in "ua":
            if len(shape) < len(rows) + 3:
                heapq.heappush(heap, (cost + 3, audit + "I", at, shape + r, lines + (f"{ROLE[r]}:",)))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, shape, lines))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 * (faults[at] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, shape + (role[:1] or "-"), lines + (f"{role}:{text}",)))
                for r in "ua":
                    heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, shape + r, lines + (f"{ROLE[r]}:{text}",)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def made(seed, convs=150, most=7):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", " \t", "", None, "Why?", "é.", "x"]
    rows = []
    for c in range(convs):
        turns = [r.choice([None, 3, 9]) if r.random() < 0.1 else t for t in range(r.randint(1, most))]
        rows += [(None if c == 3 else c, t, r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), r.choice(texts) if r.random() < 0.6 else f"Text {r.randint(0, 99)}.") for t in turns]
    return rows


def run(spark, rows):
    spark.createDataFrame(rows, TURNS).withColumn("slice", F.lit(1)).repartition(5).write.mode("overwrite").parquet("/tmp/checkpoints/veldt-conv-test/conversations.parquet")
    found = cr.query(spark, "/tmp/checkpoints/veldt-conv-test").collect()
    assert len(found) == len({r[0] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_edits(spark, seed):
    rows = made(seed)
    assert run(spark, rows) == {c: plain(v) for c, v in damaged(rows).items()}


def test_slices_give_the_same(spark, monkeypatch):
    rows = made(5, convs=40, most=40) + [(7, 1000 + k, "user", "Same.") for k in range(200)] + [(7, 5000, "user", "Again.")] * 300
    whole = run(spark, rows)
    monkeypatch.setattr(cr, "LONG", 10)
    monkeypatch.setattr(cr, "SLICE", 7)
    assert run(spark, rows) == whole


def test_empty_and_dropped(spark):
    drop = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert run(spark, [(1, drop, "user", "a.")]) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    short, long = cr.repair(spark.createDataFrame([], TURNS))
    assert cr.summary(short).count() == 0 and long is None


def test_no_code_is_a_prefix_and_order_is_that_of_strings():
    codes = {code for i in "sua-" for fault in ("", "blank", "truncated") for _, code, _, _, _ in cr.macros(i, fault)}
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert [c for c in sorted(codes) if c in ("D", "IK", "K", "R")] == ["D", "IK", "K", "R"]
