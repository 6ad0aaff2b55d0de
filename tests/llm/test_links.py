"""Embedding links, SimHash links and connected components against all pairs."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.common import DOCS, documents, groups, prose
from veldt.llm import common, embedding_links, simhash_links

VEC = "vec_id long, embedding array<float>, label int"


def plain_links(rows, cosine=0.93):
    def fine(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if fine(v) and lab is not None]
    edges = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= cosine]
    n = {i: 0 for i, _, _ in rows}
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    top = groups(list(n), edges)
    return sorted((i, n[i], top[i], top[i] == i) for i in n)


@pytest.mark.parametrize("seed", [1, 2])
def test_embeddings_against_all_pairs(spark, seed):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(30):
        centre = r.normal(size=12)
        for _ in range(int(r.integers(1, 8))):
            rows.append((len(rows), (centre + r.normal(scale=r.choice([0.0, 0.15, 0.3]), size=12)).astype(np.float32).tolist(), int(k % 4)))
    first = rows[0][1]
    rows += [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] + first[1:], 1), (1003, [None] + first[1:], 0), (1004, first, None), (1005, [float("inf")] + first[1:], 0), (1006, [], 0), (1007, [2 * x for x in first], 0), (1008, first[:6], 0)]
    df = spark.createDataFrame(rows, VEC).withColumn("rep", F.lit("clash")).repartition(5)
    assert sorted(map(tuple, embedding_links.near_duplicates(df).collect())) == plain_links(rows)


def test_small_runs_and_blocks_lose_no_link(spark, monkeypatch):
    r = np.random.default_rng(7)
    for run in (1, 3, 64):
        a, b = r.normal(size=(int(r.integers(1, 200)), 3)), r.normal(size=(int(r.integers(1, 200)), 3))
        a, b = a[np.lexsort(a.T)], b[np.lexsort(b.T)]
        i, j = embedding_links.near_runs(a, b, 0.3, run)
        found = set(zip(i.tolist(), j.tolist()))
        close = np.argwhere(((a[:, None] - b[None]) ** 2).sum(-1) <= 0.09)
        assert {(x // run, y // run) for x, y in close.tolist()} <= found and len(found) == len(i)
    monkeypatch.setattr(embedding_links, "BLOCK", 7)
    rows = [(k, (np.eye(12)[k % 5] + r.normal(scale=0.08, size=12)).astype(np.float32).tolist(), k % 2) for k in range(60)]
    assert sorted(map(tuple, embedding_links.near_duplicates(spark.createDataFrame(rows, VEC)).collect())) == plain_links(rows)
    x = np.array([v for _, v, _ in rows], np.float64)
    monkeypatch.setattr(embedding_links, "RUN", 4)
    u = embedding_links.unit(x)
    found = {(i, j) for a, b in embedding_links.compare(x, x, u[:, :4], u[:, :4], True, 0.93) for i, j in zip(a.tolist(), b.tolist())}
    assert found == {(i, j) for i, j in np.argwhere(u @ u.T >= 0.93).tolist() if i != j}


def test_rows_without_keys(spark, monkeypatch):
    docs = spark.createDataFrame([(k if k % 50 else None, "t", k) for k in range(2000)], "key long, text string, `a.b` long")
    lost = spark.createDataFrame([(k,) for k in range(0, 2000, 7)], "__lost long")
    for bits in (1 << 26, 1 << 10):
        monkeypatch.setattr(common, "MAP_BITS", bits)
        monkeypatch.setattr(common, "MOST_MAP_BITS", bits)
        left = common.without(docs, lost, "key")
        assert sorted(r["a.b"] for r in left.collect()) == [k for k in range(2000) if k % 50 == 0 or k % 7]
        assert common.without(docs, lost.limit(0), "key").count() == 2000


def test_hot_keys_are_spread_and_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    left = spark.createDataFrame([(min(k % 3, 1) * (k % 10), k) for k in range(300)] + [(None, 1000)], "on long, k long")
    right = left.where("on is not null").groupBy("on").agg(F.count(F.lit(1)).alias("met"))
    for how in ("inner", "left"):
        out = common.spread_join(left, right, "on", "met", 300, F.col("k"), how)
        assert out.count() == (300 if how == "inner" else 301)
        assert out.where("on is not null").select("k").distinct().count() == 300 and out.where("on = 0").count() == left.where("on = 0").count() > 100
    parts = common.spread_join(left, right, "on", "met", 300, F.col("k"), "inner")
    assert set(parts.columns) == {"on", "k", "met"}


def test_embeddings_copies_and_empty(spark):
    rows = [(k, [1.0, 0.0], 1) for k in range(50)]
    out = embedding_links.near_duplicates(spark.createDataFrame(rows, VEC)).collect()
    assert {(r["n_links"], r["component_id"]) for r in out} == {(49, 0)} and len(out) == 50
    assert embedding_links.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in low).split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark):
    r = random.Random(5)
    texts = [None, "", " \t", "one", "One two", "ONE two", "A B C D", "É é  x y z w", prose(1, 30000)]
    for k in range(25):
        base = prose(k + 10, 120).split()
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base[:60], "zz", *base[61:]]), " ".join(base[: r.randint(100, 119)])]
    df = documents(spark, texts).withColumn("fp", F.lit("clash"))
    fp = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    top = groups(list(fp), [(a, b) for a in fp for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    found = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash_links.near_duplicates(df).collect()}
    assert found == {k: (fp[k], top[k]) for k in fp}


def plain_runs(text, n=5):
    w = "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for x in w if x]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def test_first_of_similar_texts_stays(spark):
    r = random.Random(6)
    texts = [None, "", " \t", "one", "One two", "ONE two", "A B C D", "\u00c9 \u00e9  x y z w"]
    for k in range(25):
        base = prose(k + 10, 120).split()
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base[:60], "zz", *base[61:]]), " ".join(base[: r.randint(114, 119)]), " ".join(sorted(base))]
    runs = [plain_runs(t) for t in texts]
    near = [(a, b) for a in range(len(runs)) for b in range(a) if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])]
    top = groups(range(len(texts)), near)
    df = documents(spark, texts)
    for name in ("__lost", "__at", "__key", "row", "key", "a.b", "node"):
        df = df.withColumn(name, F.lit("clash"))
    kept = simhash_links.keep_first(df)
    assert kept.columns == df.columns
    stay, want = {x["doc_id"] for x in kept.collect()}, {k for k in range(len(texts)) if top[k] == k}
    # nothing goes without a similar text; a few similar ones stay, whose words' fingerprints are too far apart
    assert want <= stay and len(stay - want) <= 4 and len(texts) - len(stay) > 60 and kept.columns[-1] == "node"
    # copies of the words in another order have the same fingerprint and no runs in common
    assert simhash_links.word_print(texts[8].encode().split()) == simhash_links.word_print(texts[12].encode().split()) and top[12] == 12
    assert simhash_links.keep_first(documents(spark, []).limit(0)).count() == 0


def test_simhash_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash_links, "BUCKET_ROWS", 20)
    r = random.Random(1)
    codes = [r.getrandbits(64) & 0xFFF0_0FF0_00FF_F00F for _ in range(60)]
    for c in list(codes):
        for _ in range(4):
            for b in r.sample(range(64), r.randint(1, 5)):
                c ^= 1 << b
            codes.append(c)
    codes = list(dict.fromkeys(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(zip(signed, range(len(codes)))), "fp long, rep long")
    edges = [(x["a"], x["b"]) for x in simhash_links.links(df).collect()]
    want = groups(range(len(codes)), [(a, b) for a in range(len(codes)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 4])
    assert groups(range(len(codes)), edges) == want


def test_gray_index_counts_all_differences(monkeypatch):
    r = np.random.default_rng(2)
    codes = np.unique(r.integers(0, 2**63, 40, dtype=np.uint64))
    near = codes ^ (np.uint64(1) << r.integers(0, 64, len(codes)).astype(np.uint64))
    codes = np.unique(np.concatenate([codes, near, near ^ np.uint64(6)]))
    codes = codes[np.argsort(simhash_links.gray_rank(codes))]
    monkeypatch.setattr(simhash_links, "LEAF", 2)
    left, right = simhash_links.GrayIndex(codes).block_pairs(4)
    found = set(zip(left.tolist(), right.tolist()))
    links = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None]) <= 4)
    assert {(a // 2, b // 2) for a, b in links.tolist() if a <= b} <= found
    assert len(found) < (len(codes) // 2) ** 2 / 4


def test_simhash_null_keys_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1)], DOCS)
    assert sorted(((r["doc_id"], r["component_id"]) for r in simhash_links.near_duplicates(df).collect()), key=str) == [(4, 4), (4, 4), (None, 4)]
    assert simhash_links.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(700, 701), (701, 702), (702, 700), (700, 700)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in common.components(df).collect()}
    assert found == groups(sorted({x for e in edges for x in e}), edges)
    assert common.components(df.limit(0)).count() == 0


def test_first_of_similar_texts_compares_all_in_reach(spark):
    """Texts of the same words lie on one spot; similar ones may be neither first there nor most alike by their fingerprints."""
    r = random.Random(8)
    words = prose(3, 90).split()
    texts = []
    for _ in range(12):
        r.shuffle(words)
        base = list(words)
        for _ in range(12):
            w = list(base)
            # swaps of neighbours change runs and no word
            for k in r.sample(range(0, 85), r.randint(0, 3)):
                w[k], w[k + 1] = w[k + 1], w[k]
            texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    runs = [plain_runs(t) for t in texts]
    near = [(a, b) for a in range(len(runs)) for b in range(a) if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])]
    top = groups(range(len(texts)), near)
    assert {x["doc_id"] for x in simhash_links.keep_first(documents(spark, texts)).collect()} == {k for k in top if top[k] == k}
