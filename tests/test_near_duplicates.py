"""Near-duplicates of the library on a family of similar texts."""

import random

from veldt.operators import preparation


def test_a_family_makes_no_pairs_of_all_its_members(spark, monkeypatch):
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join([*words[: k % 200], f"x{k}", *words[k % 200 + 1 :]]) for k in range(300)] + [" ".join(f"{n}y{k}" for k in range(50)) for n in range(5)]
    edges, own = [], preparation.components
    monkeypatch.setattr(preparation, "components", lambda links, a, b: edges.append(links.count()) or own(links, a, b))
    found = preparation.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    assert {x["id"]: x["cluster"] for x in found.collect()} == {k: 0 if k < 300 else k for k in range(305)}
    # all pairs would be 44850
    assert max(edges) < 5000


def test_sets_that_share_few_heads_are_not_compared(spark, monkeypatch):
    run = {(a, b): " ".join(f"r{a}x{b}x{k}" for k in range(40)) for a in range(6) for b in range(a)}
    texts = [" ".join(run[max(a, b), min(a, b)] for b in range(6) if b != a) for a in range(6)]
    compared, own = [], preparation._similar
    monkeypatch.setattr(preparation, "_similar", lambda pairs, *rest: compared.append(pairs.count()) or own(pairs, *rest))
    found = preparation.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    assert {x["id"]: x["cluster"] for x in found.collect()} == {k: k for k in range(6)}
    assert sum(compared) == 0


def test_pairs_around_the_bound_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(preparation, "ASKED", 0)
    r = random.Random(8)
    texts = []
    for _ in range(25):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([5, 6, 9, 14, 30, 60, 90]))]
        for _ in range(6):
            some = [w if r.random() > 0.015 else f"z{r.randint(0, 9)}" for w in base]
            texts.append(" ".join(some[: len(some) - r.randint(0, max(0, len(some) // 12))]))
    texts += texts[:5]
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))} for t in texts]
    cluster, links = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) * 0.8:
                links += sets[a] != sets[b]
                low, high = sorted((cluster[a], cluster[b]))
                cluster = [low if c == high else c for c in cluster]
    assert links > 50
    found = preparation.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    assert [x["cluster"] for x in sorted(found.collect())] == cluster
