"""The fuzzy join against all pairs."""

import random
import re

import pytest

from veldt.functions.text import Term
from veldt.operators import fuzzy


def distance(a, b):
    """Insertions, deletions, changes and swaps of neighbours, each letter edited once."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def near(term, word):
    most, n = (len(term) >= 4) + (len(term) >= 8), len(term)
    return term in word or (most > 0 and len(word) >= n - most and (distance(term, word[:n]) <= most or (n < len(word) <= n + most and distance(term, word) <= most)))


def damaged(r, word):
    for _ in range(r.randint(0, 3)):
        k = r.randrange(len(word) + 1)
        word = r.choice([word[:k] + r.choice("abc1") + word[k:], word[:k] + word[k + 1 :], word[:k] + word[k + 1 : k + 2] + word[k : k + 1] + word[k + 2 :], word + "abc"])
    return word


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde1") for _ in range(r.randint(1, 11))) for _ in range(40)]
    texts = [(k, " ".join(damaged(r, r.choice(base)) for _ in range(r.randint(0, 4))).upper() + r.choice(["", "!", " é"])) for k in range(300)] + [(900, None), (901, "")]
    queries = [(k, " ".join(damaged(r, r.choice(base)) for _ in range(r.randint(0, 2)))) for k in range(60)] + [(900, None), (901, "..."), (902, "b b")]
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    want = {(q, k) for q, qt in queries for k, t in texts if words(qt) and all(any(near(a, w) for w in words(t)) for a in words(qt))}
    found = fuzzy.fuzzy_join(spark.createDataFrame(texts + texts[:5], "id long, t string"), spark.createDataFrame(queries, "q long, qt string"), "id", "t", "q", "qt")
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100


def test_forms_meet_wherever_words_are_near():
    r = random.Random(3)
    for _ in range(3000):
        a = "".join(r.choice("ab1") for _ in range(r.randint(4, 9)))
        b = damaged(r, a)
        most = Term(a).most
        if distance(a, b) <= most:
            assert fuzzy.forms(a, most) & fuzzy.forms(b, most)


def test_empty(spark):
    none = spark.createDataFrame([], "id long, t string")
    assert fuzzy.fuzzy_join(none, none, "id", "t", "id", "t").count() == 0


def test_copies_of_texts_are_one(spark, monkeypatch):
    """Many copies of a text and of a query make no more rows between than there are rows to find."""
    texts = spark.createDataFrame([(k, "alpha beta gamma delta") for k in range(2000)] + [(5000, None)], "id long, t string")
    queries = spark.createDataFrame([(k, "alpa gama") for k in range(30)] + [(None, "beta")], "q long, qt string")
    sizes, own = [], fuzzy.written
    monkeypatch.setattr(fuzzy, "written", lambda frame, name: sizes.append(own(frame, name)) or sizes[-1])
    found = fuzzy.fuzzy_join(texts, queries, "id", "t", "q", "qt")
    assert found.count() == found.distinct().count() == 60_000
    assert max(x.count() for x in sizes) == 2000
