"""Toxic passages against a plain segment search, and held-out documents."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.common import DOCS, prose
from veldt.llm import toxicity as tx

LABELS = "doc_id long, quality int, toxic int"
#: Made-up stems; toxic words start with one and go on.
STEMS = ["zorgu", "plimfa", "quatsi"]


def plain_segments(scores):
    """By the definition: the best segment of greatest sum (shortest, leftmost of equals), then those of what lies left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = round(sum(scores[i:j]), 9)
            if s > 0 and (best is None or (-s, j - i, i) < best[:3]):
                best = (-s, j - i, i)
    if best is None:
        return []
    i, j = best[2], best[2] + best[1]
    return plain_segments(scores[:i]) + [(i, j, -best[0])] + [(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]


@pytest.mark.parametrize("seed", range(40))
def test_segments_against_the_definition(seed):
    r = random.Random(seed)
    scores = np.array([r.choice([-3.1, -1.07, -0.53, 0.71, 1.3, 4.9]) + r.random() / 100 for _ in range(r.randint(0, 40))])
    assert [(a, b, round(s, 6)) for a, b, s in tx.maximal_segments(scores)] == [(a, b, round(s, 6)) for a, b, s in plain_segments(scores.tolist())]


def test_a_long_text_takes_linear_time():
    scores = np.where(np.arange(400_000) % 2 == 0, 1.0, -1.0 + 1e-6 * np.sin(np.arange(400_000)))
    assert tx.maximal_segments(scores)
    falling = np.where(np.arange(400_000) % 2 == 0, 1.0, -1.5)
    assert len(tx.maximal_segments(falling)) == 200_000


def made(n=600, seed=1):
    """Documents of which a tenth holds toxic words, some with no toxic label, and repeated words in clean ones."""
    r, docs, labels = random.Random(seed), [], []
    for k in range(n):
        words = prose(k, r.randint(5, 300)).split()
        toxic = k % 10 == 0
        if toxic:
            for _ in range(3 + len(words) // 40):
                words.insert(r.randrange(len(words)), r.choice(STEMS) + "".join(r.choice("abdeo") for _ in range(r.randint(1, 4))))
        elif k % 17 == 0:
            words += [r.choice(words)] * 200
        docs.append((k, " ".join(words).capitalize() + ".", "en", "s", 0))
        if k % 3 < 2:
            labels.append((k, 0, int(toxic)))
    copies = [(n + k, docs[5][1], "en", "s", 0) for k in range(200)]
    return docs + copies, labels + [(n + k, 0, int(k % 2)) for k in range(200)]


def test_held_out_documents(spark):
    docs, labels = made()
    docs += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (5002, "123 !?", "en", "s", 0), (5003, "Zorguabe İstanbul " * 3, "en", "s", 0)]
    labels += [(5003, 0, 1), (5003, 0, 0), (None, 0, 1), (7, 0, None)]
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    model = tx.train(df, spark.createDataFrame(labels, LABELS))
    rows = {r["doc_id"]: r for r in tx.find(df, model).collect()}
    assert len(rows) == len(docs) and all(0 <= r["toxic_score"] <= 1 for r in rows.values())
    unseen = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    wrong = [k for k in unseen if (rows[k]["toxic_score"] >= 0.5) != (k % 10 == 0)]
    assert len(wrong) <= len(unseen) // 25, wrong
    assert len({rows[k]["toxic_score"] for k in (5000, 5001, 5002)}) == 1 and rows[5000]["toxic_passages"] == []
    for r in rows.values():
        for p in r["toxic_passages"]:
            assert r["text"][p["start"] : p["end"]].strip() and r["text"][p["start"]].isalpha() and r["text"][p["end"] - 1].isalpha()
    assert tx.find(df.limit(0), model).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 0), (2, None, "en", "s", 0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r["toxic_score"] for r in tx.find(df, tx.train(df, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 0, 1), (3, 0, 1)], LABELS)
    assert {r["toxic_score"] for r in tx.find(df, tx.train(df, one)).collect()} == {1.0}
    both = spark.createDataFrame([(1, 0, 1), (3, 0, 0)], LABELS)  # no text of one label
    assert len({r["toxic_score"] for r in tx.find(df, tx.train(df, both)).collect()}) == 1


def test_scores_follow_stems():
    import pandas as pd

    words = {"zorguab": (9, 0), "zorguda": (9, 0), "zorgu": (1, 80), "zorgless": (0, 60), "plain": (10, 100)}
    nodes = {}
    for w, (a, b) in words.items():
        for n in [w + "$", *[w[:k] + "-" for k in range(2, min(8, len(w) - 1) + 1)]]:
            x = nodes.setdefault(n, [0, 0])
            x[0] += a
            x[1] += b
    odds = tx.node_scores(pd.DataFrame([(n, a, b) for n, (a, b) in nodes.items()], columns=["node", "a", "b"]), 40, 400)
    model = tx.Model(tx.pruned(odds))
    assert model.word("zorguxyz") > 1 > 0 > model.word("zorgless") and model.word("zorgu") < 0 and abs(model.word("plain") + tx.DRIFT) < 0.3


def test_extremes_are_found_again():
    r = np.random.default_rng(3)
    n = r.integers(20, 2000, 5000).astype(float)
    best = (np.log(0.05 * n) + r.gumbel(size=5000)) / 0.8
    scale, k = tx.extremes(best, n)
    assert abs(scale - 0.8) < 0.05 and abs(np.log(k / 0.05)) < 0.3
