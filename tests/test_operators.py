"""Operators against plain Python and against their laws, on small made-up rows with nulls, ties and repeats."""

import itertools
import random
import re
import unicodedata
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldt.functions import numbers, text, vectors
from veldt.operators import annotation, evaluation, events, joins, keyed, ordering, paging, preparation, quality, retrieval, sets, stats, timeseries
from veldt.sources import sinks, tables
from veldt.streaming import events as streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_latest_keeps_nulls_and_null_keys(spark):
    df = frame(spark, [(1, 1, "a"), (1, 2, None), (None, 3, "x"), (None, 4, "y")], "k int, o int, v string")
    assert got(keyed.latest_per_key(df, "k", ["o"])) == sorted([(1, 2, None), (None, 4, "y")], key=repr)
    assert keyed.latest_per_key(df.limit(0), "k", ["o"]).count() == 0


def test_as_of_is_not_hidden_by_a_later_row(spark):
    df = frame(spark, [(1, 1, 10), (1, 5, 50)], "k int, at int, v int")
    assert got(keyed.as_of(df, "k", "at", F.lit(3), ["at"])) == [(1, 1, 10)]


def test_baseline_reasons(spark):
    d = lambda day: datetime(2024, 1, day)
    df = frame(spark, [(1, d(1), 1, 100.0), (2, d(1), 1, 0.0), (2, d(9), 2, 5.0), (3, d(1), 1, 10.0), (3, d(1), 2, 5.0), (4, d(1), 1, 100.0), (4, d(30), 2, 80.0)], "k int, at timestamp, id int, v double")
    found = {r["k"]: (r["reason"], r["stalled"]) for r in keyed.baseline_change(df, "k", "at", "id", "v").collect()}
    assert found == {1: (keyed.REASONS[1], False), 2: (keyed.REASONS[3], False), 3: (keyed.REASONS[2], False), 4: (None, True)}


def even_index(values, q):
    return values[min(len(values) - 1, max(0, int(round(q * len(values) + 0.5)) - 1))]


@pytest.mark.parametrize("n", [1, 2, 10, 20, 21])
def test_percentile_definitions(spark, n):
    values = [random.Random(n).choice([1.0, 2.0, 3.0, 5.0, 8.0]) for _ in range(n)]
    df = frame(spark, [("g", v) for v in values] + [("g", None)], "g string, v double")
    row = stats.percentiles(df, ["g"], "v", {"p": 0.95}).first()
    assert row["p_even"] == even_index(sorted(values), 0.95)
    import numpy as np

    assert row["p_linear"] == pytest.approx(np.percentile(values, 95))
    assert stats.percentiles(df.where("v IS NULL"), ["g"], "v", {"p": 0.5}).count() == 0


def test_running_totals_with_ties_in_slices(spark):
    rows = [(g, k, float(k % 3)) for g in "ab" for k in range(300)]
    df = frame(spark, rows, "g string, k int, v double")
    found = {(r["g"], r["k"]): r["running"] for r in ordering.running_totals(df, ["g"], "k", F.col("v"), slices=7).collect()}
    for g in "ab":
        total = 0.0
        for k in range(300):
            total += k % 3
            assert found[g, k] == total


@pytest.mark.parametrize("rows,want", [([(1, 0.9), (0, 0.1)], 1.0), ([(1, 0.1), (0, 0.9)], 0.0), ([(1, 0.5), (0, 0.5)], 0.5), ([(1, 0.5)], None)])
def test_auroc(spark, rows, want):
    df = frame(spark, rows, "y int, s double")
    assert evaluation.auroc(df, "y", "s").first()["auroc"] == want


def test_membership_neither_loses_nor_doubles(spark):
    df = frame(spark, [(1,), (2,), (None,)], "k int")
    other = frame(spark, [(1,), (1,), (None,)], "x int")
    assert got(joins.membership(df, "k", {"is_in": other})) == sorted([(1, True), (2, False), (None, False)], key=repr)


def test_strict_lookup_fails_closed(spark):
    df, dim = frame(spark, [(1,), (2,)], "k int"), frame(spark, [(1, "a")], "d int, v string")
    with pytest.raises(Exception, match="no row for k 2"):
        joins.strict_lookup(df, dim, "k", "d", ["v"]).collect()


def test_pages(spark):
    df = frame(spark, [(k, 40) for k in range(1, 8)], "seq int, size int")
    page = paging.keyset_page(df, "seq", 2, 3).collect()
    assert [(r["seq"], r["has_more"], r["next_cursor"]) for r in page] == [(3, True, 5), (4, True, 5), (5, True, 5)]
    assert paging.keyset_page(df, "seq", 99, 3).count() == 0
    assert paging.budget_batch(df, ["seq"], "size", 50, 100).count() == 2
    assert paging.budget_batch(df, ["seq"], "size", 50, 10).count() == 1  # the first row always goes


def test_set_differences(spark):
    a, b = frame(spark, [(1,), (1,), (2,), (None,)], "x int"), frame(spark, [(2,), (3,), (None,)], "y int")
    assert tuple(sets.difference_counts(a, b).first()) == (1, 1, 2)
    assert tuple(sets.difference_counts(a.limit(0), b.limit(0)).first()) == (0, 0, 0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from(["a", "b", "c"])), st.just(0)), max_size=6), st.sets(st.sampled_from(["a", "b", "c"])))
def test_gate_law(spark, rows, observed):
    df = frame(spark, [(k, sorted(r)) for k, (r, _) in enumerate(rows)], "id int, req array<string>")
    one = {r["id"]: r["admissible"] for r in retrieval.gate(df, "req", sorted(observed), ["a", "b", "c"]).collect()}
    assert one == {k: r <= observed for k, (r, _) in enumerate(rows)}
    more = {r["id"]: r["admissible"] for r in retrieval.gate(df, "req", ["a", "b", "c"], ["a", "b", "c"]).collect()}
    assert all(more.values())  # observing more never withholds


def test_gate_unknown_field_raises(spark):
    df = frame(spark, [(1, ["zz"])], "id int, req array<string>")
    with pytest.raises(Exception, match="unknown field zz"):
        retrieval.gate(df, "req", ["a"], ["a"]).collect()


def test_fusion_with_one_side_missing(spark):
    d = frame(spark, [("q", 1, 1), ("q", 2, 2)], "q string, id long, rank int")
    x = frame(spark, [("q", 2, 1), ("p", 9, 1)], "q string, id long, rank int")
    found = {(r["q"], r["id"]): r["rank"] for r in retrieval.fuse(d, x, "q", "id", 10).collect()}
    assert found == {("q", 2): 1, ("q", 1): 2, ("p", 9): 1}


def test_rerank_needs_every_score(spark):
    ranked = frame(spark, [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 3, 2)], "q string, id long, rank int")
    scores = frame(spark, [(1, 0.1), (2, 0.9)], "id long, score double")
    found = {(r["q"], r["id"]): r["final_rank"] for r in retrieval.rerank(ranked, scores, "q", "id").collect()}
    assert found == {("a", 2): 1, ("a", 1): 2, ("b", 1): 1, ("b", 3): 2}


def test_classify_is_idempotent(spark):
    rows = [("e1", "x", 1, 1), ("e2", "x", 1, 2), ("e1", "x", 1, 3), ("e3", "x", 2, 4)]
    df = frame(spark, rows, "event string, entity string, rev int, ord int")
    out = {r["ord"]: r["outcome"] for r in events.classify(df, "event", "entity", "rev", "ord").collect()}
    assert out == {1: "persisted", 2: "conflict", 3: "deduplicated", 4: "persisted"}
    replay = df.unionByName(df.withColumn("ord", F.col("ord") + 100))
    again = {r["ord"]: r["outcome"] for r in events.classify(replay, "event", "entity", "rev", "ord").collect()}
    assert {k: v for k, v in again.items() if k < 100} == out and {v for k, v in again.items() if k > 100} == {"deduplicated"}


def test_watermark_of_readers(spark):
    readers = frame(spark, [("g", 1, True), ("g", 2, True), ("h", 3, False)], "grp string, id int, active boolean")
    cursors = frame(spark, [(1, 7)], "id int, seq long")
    assert got(events.low_watermarks(readers, cursors, "grp", "id", "seq", F.col("active"))) == [("g", 0, 2), ("h", None, 0)]


def test_last_value_keeps_null(spark):
    df = frame(spark, [("f", 1, 5), ("f", 2, None)], "fam string, a int, b int")
    assert got(events.lifetimes(df, "fam", "a", "b")) == [("f", 1, None, 2)]


def test_unknown_state_raises(spark):
    with pytest.raises(Exception, match="unknown state"):
        events.furthest_state(frame(spark, [(1, "zz")], "k int, s string"), "k", "s", {"a": 0}).collect()


def test_counter_reset(spark):
    df = frame(spark, [("s", 1, 5.0), ("s", 2, 8.0), ("s", 3, 2.0)], "k string, at int, v double")
    assert [r["increase"] for r in timeseries.increases(df, ["k"], "at", "v").orderBy("at").collect()] == [0.0, 3.0, 2.0]


def test_histogram_quantile_beyond_the_last_bound(spark):
    df = frame(spark, [("k", 5.0), ("k", 500.0)], "k string, v double")
    buckets = timeseries.bucket_counts(df, ["k"], "v", [10, 20])
    assert timeseries.histogram_quantile(buckets, ["k"], 0.99).first()["quantile"] == 20.0
    assert timeseries.histogram_quantile(buckets, ["k"], 0.25).first()["quantile"] == 5.0


def test_rules_and_decisions(spark):
    df = frame(spark, [(1, 5), (2, None)], "id int, v int")
    assert got(quality.violations(df, "id", {"positive": F.col("v") > 0})) == [(2, "positive")]
    codes = frame(spark, [(1, "a", "b"), (2, None, None)], "id int, x string, y string")
    found = quality.decide(codes, ["x", "y"], [("b", "stop"), ("a", "warn")], ["stop", "warn"]).select("id", "level", "code")
    assert got(found) == [(1, "stop", "b"), (2, "ok", None)]
    with pytest.raises(Exception, match="unknown code"):
        quality.decide(codes, ["x"], [("b", "stop")], ["stop"]).collect()


def test_frozen_versions_reject_changes(spark):
    versions = frame(spark, [("v1", "2024"), ("v2", None)], "ver string, frozen string")
    assert quality.reject_frozen(frame(spark, [("v2", 1)], "ver string, x int"), versions, "ver", "frozen").count() == 1
    with pytest.raises(Exception, match="frozen: v1"):
        quality.reject_frozen(frame(spark, [("v1", 1)], "ver string, x int"), versions, "ver", "frozen").collect()


def test_versioned_load(spark, tmp_path):
    home = str(tmp_path / "corpus")
    df = frame(spark, [(1,), (2,)], "x int")
    sinks.load_version(df, home, "r1", {"two rows": lambda d: d.count() == 2})
    with pytest.raises(ValueError, match="exists"):
        sinks.load_version(df, home, "r1", {})
    with pytest.raises(ValueError, match="three rows"):
        sinks.load_version(df, home, "r2", {"three rows": lambda d: d.count() == 3})
    assert not sinks.exists(spark, f"{home}/r2")
    sinks.freeze(spark, home, "r1")
    with pytest.raises(ValueError, match="frozen"):
        sinks.load_version(df, home, "r1", {}, replace=True)


def plain_components(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)]
    edges = [e for e in edges if e[0] != e[1]]
    found = {x["node"]: x["component"] for x in preparation.components(frame(spark, edges, "a long, b long"), "a", "b").collect()}
    assert found == plain_components(edges)


def test_split_keeps_groups_whole(spark):
    df = frame(spark, [(k, f"g{k % 17}", f"s{k % 17 % 3}") for k in range(400)], "id int, grp string, str string")
    out = preparation.group_split(df, "grp", "str", 0.3, 1)
    assert out.count() == 400 and preparation.leaks(out, "grp", "held").count() == 0
    assert 0.1 < out.where("held").count() / 400 < 0.5


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghij") * 2 + str(r.randrange(40)) for _ in range(60)) for _ in range(12)]
    docs = []
    for b in base:
        w = b.split()
        docs += [b, b, " ".join([*w[:-1], "end"]), " ".join([*w[:20], "x", *w[21:40], "y", *w[41:]])]
    docs += ["", "", "one two", "one two"]
    df = frame(spark, list(enumerate(docs)), "id long, t string")
    sh = [{tuple(d.split()[k : k + 5]) for k in range(max(1, len(d.split()) - 4))} for d in docs]
    edges = [(i, j) for i in range(len(docs)) for j in range(i) if len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j])]
    want = plain_components(edges)
    found = {x["id"]: x["cluster"] for x in preparation.near_duplicates(df, "id", "t").collect()}
    assert found == {k: want.get(k, k) for k in range(len(docs))}


def test_suppression(spark):
    df = frame(spark, [("g", 1, 0, 10, 0.9), ("g", 2, 5, 15, 0.8), ("g", 3, 12, 20, 0.7), ("h", 4, 0, 10, 0.1)], "g string, id int, a int, b int, s double")
    assert sorted(r["id"] for r in preparation.suppress(df, "g", "a", "b", "s", "id").collect()) == [1, 3, 4]


def test_scrub(spark):
    t = "Mr perera, MRN: A-1234, mail a.b@c.org, on 12/03/2024 or 3 Mar 2024, call +94 77 123 4567"
    clean, kinds = text.scrub(F.col("t"))
    row = frame(spark, [(t,), (None,)], "t string").select(clean.alias("c"), kinds.alias("k")).collect()
    assert row[0]["c"] == "[name removed], [ID removed], mail [email removed], on [date removed] or [date removed], call [number removed]"
    assert row[0]["k"] == ["name", "identifier", "email", "date", "number"] and row[1]["c"] is None


@pytest.mark.parametrize("said,want", [("ok [S1]", None), ("near [s1] [S1]", "malformed [s1]"), ("[S01]", "malformed [S01]"), ("[S1, S2]", "malformed [S1, S2]"), ("x [S3]", "not issued [S3]"), ("none", "no tag at the end")])
def test_tags(spark, said, want):
    df = frame(spark, [(said,)], "t string")
    assert df.select(text.tag_problem(F.col("t"), F.array(F.lit("S1"), F.lit("S2")))).first()[0] == want


def test_text_helpers(spark):
    assert text.Term("form").distance("from") == 1 and text.Term("abc").distance("xyz") == 3 and text.Term("ca").distance("abc") == 3
    assert text.common_length(list("abcde"), list("ace")) == 3
    df = frame(spark, [("deactivated user",), ("other",), (None,)], "t string")
    assert [r[0] for r in df.select(text.fuzzy_match("deactvat")("t")).collect()] == [True, False, False]
    e = frame(spark, [(unicodedata.normalize("NFD", "é"),), (None,)], "t string").select(text.nfc("t")).collect()
    assert [r[0] for r in e] == ["é", None]
    j = frame(spark, [('{"b": 1.50, "a": [1, {"d": null, "c": true}]}',), ("{bad",), (None,)], "t string")
    assert [r[0] for r in j.select(text.canonical_json("t")).collect()] == ['{"a":[1,{"c":true,"d":null}],"b":1.50}', None, None]


def plain_distance(a, b):
    """Missing, extra, wrong and swapped neighbouring letters, no part changed twice."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_distances(a, b):
    assert text.Term(a).distance(b) == plain_distance(a, b)


def plain_fuzzy(query, said):
    words = re.findall("[a-z0-9]+", said.lower())

    def hit(term):
        most = 2 if len(term) >= 8 else 1 if len(term) >= 4 else 0
        return term in said.lower() or any(most and (plain_distance(term, w) <= most or len(w) > len(term) and plain_distance(term, w[: len(term)]) <= most) for w in words)

    return all(hit(term) for term in re.findall("[a-z0-9]+", query.lower()))


def test_fuzzy_search_against_plain_words(spark):
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 10))) for _ in range(r.randint(0, 5))) for _ in range(150)]
    df = frame(spark, [(t,) for t in [*texts, None]], "t string")
    for query in ("abcd", "abcdabcd bc", "dcba, ab", "", "aabbccdd"):
        assert [x[0] for x in df.select(text.fuzzy_match(query)("t")).collect()] == [plain_fuzzy(query, t) for t in texts] + [query == "" and False]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_subsequences(a, b):
    want = {(i, j): 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            want[i, j] = want[i + 1, j + 1] + 1 if a[i] == b[j] else max(want[i + 1, j], want[i, j + 1])
    table = type("Small", (text.Subsequence,), {"STEP": 4})(a, b)
    assert all(table.length(i, j) == n for (i, j), n in want.items())


def test_word_difference_keeps_a_longest_subsequence(spark):
    r = random.Random(9)
    pairs = [(" ".join(r.choices("pqrs", k=r.randint(0, 9))), " ".join(r.choices("pqrs", k=r.randint(0, 9)))) for _ in range(60)] + [(None, "x"), ("X y", "x Z")]
    rows = frame(spark, pairs, "a string, b string").select("a", "b", text.word_difference("a", "b").alias("d")).collect()
    for x in rows:
        a, b = (x["a"] or "").lower().split(), (x["b"] or "").lower().split()
        n = text.common_length(a, b)
        assert len(x["d"]["only_a"]) == len(a) - n and len(x["d"]["only_b"]) == len(b) - n
    assert rows[-1]["d"] == (["y"], ["z"])


def test_best_cuts_against_all_cuts():
    r = random.Random(1)

    def worth(tokens, ends, above):
        sizes = [sum(tokens[a:b]) + above for a, b in zip([0, *ends], ends)]
        alone = len(ends) == 1
        return sum(x > 40 for x in sizes), sum(x < 25 and not alone for x in sizes), len(ends), sum((x - 32) ** 2 for x in sizes)

    for _ in range(300):
        tokens, above = [r.randint(1, 50) for _ in range(r.randint(1, 8))], r.choice([0, 3])
        cuts = [[*c, len(tokens)] for k in range(len(tokens)) for c in itertools.combinations(range(1, len(tokens)), k)]
        allowed = [c for c in cuts if all(sum(tokens[a:b]) + above <= 40 or b == a + 1 for a, b in zip([0, *c], c))]
        assert worth(tokens, text.best_cuts(tokens, above, 25, 40), above) == min(worth(tokens, c, above) for c in allowed)


def test_sentences_and_headed_chunks(spark):
    said = "One two. Three four!\" Five six.12,13 Seven? eight. Nine \u2022 ten \u2022 x"
    df = frame(spark, [(said,), (None,), ("",)], "t string")
    assert df.select(text.sentences(F.col("t"))).first()[0] == ["One two.", "Three four!\"", "Five six.12,13", "Seven? eight.", "Nine", "\u2022 ten", "\u2022 x"]
    count = text.word_pieces(["\u2581one", "\u2581two", "\u2581th", "ree", "\u2581."])
    assert frame(spark, [(["One two.", "THR\u00c9E", "zzz!", ""],)], "a array<string>").select(count("a")).first()[0] == [3, 2, 2, 0]
    rows = text.chunked(df, "t", 3, 6, count, F.lit("one")).collect()
    assert [len(r["pieces"]) for r in rows] == [5, 0, 0] and all(said[p["offset"] :].startswith(p["text"]) for p in rows[0]["pieces"])
    assert "".join(said.split()) == "".join("".join(p["text"].split()) for p in rows[0]["pieces"]) and [p["n_words"] for p in rows[0]["pieces"]] == [4, 6, 7, 6, 5]


RULES = annotation.Rules(
    openers=[r"in\b"], start=r"\bpeople with\b", ends=[r"[,:]\s*(?:use|do)\b", r"\sshould\b"], fields={"foot": [r"foot\b"], "infection": [r"infect\w*"], "pulse": ["pulse"]},
    qualifier=r"\b(?:suspected|possible)\b", prohibit=["do not"], prohibit_anywhere=r"\bnever\b",
)


def test_annotation(spark):
    said = ["In people with a foot ulcer, use rest for the pulse", "In a possible infected foot, do not wait", "People with infection should never run: people with a pulse should", "Nothing", None, "In one foot"]
    rows = annotation.annotate(frame(spark, [(t,) for t in said], "t string"), "t", RULES).collect()
    assert [r["opening"] for r in rows] == ["In people with a foot ulcer", "In a possible infected foot", None, None, None, "In one foot"]
    assert [r["clauses"] for r in rows] == [["people with a foot ulcer"], [], ["People with infection", "people with a pulse"], [], [], []]
    assert [r["required"] for r in rows] == [["foot"], [], ["infection", "pulse"], [], [], ["foot"]]
    assert [r["mentioned"] for r in rows] == [["pulse"], ["foot", "infection"], [], [], [], []]
    assert [r["polarity"] for r in rows] == ["RECOMMEND", "PROHIBIT", "PROHIBIT", "RECOMMEND", "RECOMMEND", "RECOMMEND"]
    assert rows[1]["flags"] == ["field behind a qualifier does not count"] and rows[3]["flags"] == ["no clause"] and rows[5]["flags"] == ["opening clause runs to the end"]


def test_differences_that_touch_clauses(spark):
    df = frame(spark, [("people with a foot ulcer should rest", "people with an ulcer should rest"), ("people with pain should rest 2 days", "people with pain should rest"), ("a b", "a b")], "a string, b string")
    out = annotation.difference_report(df.withColumn("d", text.word_difference("a", "b")), "d", "a", "b", RULES)
    assert got(out.select("touches_clause", "touches_number")) == sorted([(True, False), (False, True), (False, False)], key=str)


def test_thresholds_are_quoted(spark):
    texts = frame(spark, [("a", "Wait. Press 2.5 kPa or more. Then 3 and 3"), ("b", "none")], "id string, t string")
    asked = frame(spark, [("a", "2.5 kPa", 2.5), ("a", "3", 3.0), ("b", "4", 4.0), ("c", "4", 4.0), ("a", "2.5 kPa", 9.0)], "id string, token string, value double")
    found = annotation.locate(asked, texts, "id", "token", "value", "t").collect()
    assert {(r["id"], r["token"], r["value"]): (r["quoted"], r["problem"]) for r in found} == {
        ("a", "2.5 kPa", 2.5): ("Press 2.5 kPa or more.", None), ("a", "3", 3.0): (None, "found 2 times"), ("b", "4", 4.0): (None, "found 0 times"), ("c", "4", 4.0): (None, "no text"), ("a", "2.5 kPa", 9.0): (None, "other value"),
    }


def test_phrases_and_mappings(spark, tmp_path):
    slots = {"grade": {"mild": "infection mild"}, "pulse": {"yes": "pulse present"}}
    assert frame(spark, [("mild", "yes")], "grade string, pulse string").select(annotation.summary(slots, "Findings")).first()[0] == "Findings: infection mild; pulse present."
    with pytest.raises(Exception, match="no phrase for grade = severe"):
        frame(spark, [("severe", "yes")], "grade string, pulse string").select(annotation.summary(slots, "Findings")).collect()
    (tmp_path / "m.yaml").write_text('"status": "confirmed"\n"pairs":\n- {"label": "1", "target": "R1"}\n- {"label": "2", "target": "R2"}\n- {"label": "2", "target": "R3"}\n- {"label": "9"}\n')
    mapping = tables.read_config(spark, str(tmp_path / "m.yaml"), "label string, target string, status string", "pairs")
    assert mapping.count() == 4 and annotation.confirmed(mapping).count() == 4
    names = frame(spark, [("1",), ("2",), ("3",), ("4",)], "label string")
    found = annotation.mapping_problems(annotation.confirmed(mapping), names, "label", "target", frame(spark, [("4",)], "label string"))
    assert {tuple(r) for r in found.collect()} == {("2", 2, "several"), ("3", 0, "missing"), ("9", 0, "unknown")}
    (tmp_path / "p.yaml").write_text("status: proposed\npairs:\n- {label: '1', target: R1}\n")
    with pytest.raises(Exception, match="not confirmed"):
        annotation.confirmed(tables.read_config(spark, str(tmp_path / "p.yaml"), "label string, target string, status string", "pairs")).collect()
    with pytest.raises(ValueError, match="unknown names"):
        tables.read_config(spark, str(tmp_path / "p.yaml"), "label string, status string", "pairs")


def test_regions(spark):
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (0, 1), (1, 0), (9, 9), (9, 8), (0, 20)])]
    rows = stats.regions(frame(spark, [*points, (9, None, 1.0)], "k int, x double, y double"), "k", ["x", "y"], 3).collect()
    assert [(r["region"], r["n"], r["percent"]) for r in rows] == [(1, 3, 50.0), (2, 2, 33.3), (3, 1, 16.7)] and rows[2]["c_y"] == 20.0
    assert stats.regions(frame(spark, [(1, 2.0), (2, 2.0)], "k int, x double"), "k", ["x"], 3).count() == 1
    assert stats.regions(frame(spark, [], "k int, x double"), "k", ["x"], 3).count() == 0


def test_chunks_restore_the_text(spark):
    r = random.Random(1)
    t = " ".join(f"Word{' w' * r.randrange(5, 60)}." for _ in range(60))
    df = frame(spark, [(1, t), (2, ""), (3, None)], "id int, t string")
    rows = text.chunked(df, "t", 100, 160).select("id", F.explode("pieces").alias("x")).select("id", "x.*").collect()
    assert {r["id"] for r in rows} == {1}
    assert " ".join(r["text"] for r in rows) == t and all(r["n_words"] <= 160 for r in rows)
    assert all(t[r["offset"] :].startswith(r["text"]) for r in rows)


def test_numbers_and_vectors(spark):
    df = frame(spark, [([{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 3.0}], [3, 3, 1], [3.0, 4.0], [0.0, 0.0])], "p array<struct<x:double,y:double>>, c array<long>, v array<float>, z array<float>")
    row = df.select(numbers.shoelace("p").alias("a"), numbers.percent_parts("c").alias("c"), vectors.norm(F.col("v")).alias("n"), vectors.cosine(F.col("v"), F.col("z")).alias("k"), vectors.parse_vector(vectors.format_vector(F.col("v"))).alias("r")).first()
    assert row["a"] == 3.0 and sum(row["c"]) == pytest.approx(100.0) and row["n"] == 5.0 and row["k"] is None and row["r"] == [3.0, 4.0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,\n")
    assert got(tables.read_csv(spark, str(tmp_path / "a.csv"), "id int, v string")) == [(1, "x"), (2, None)]
    (tmp_path / "a.jsonl").write_text('{"k":"a","n":1,"v":1}\n{"k":"a","n":2,"v":2}\n')
    assert got(tables.read_jsonl_latest(spark, str(tmp_path / "a.jsonl"), "k string, n int, v int", "k", "n")) == [("a", 2, 2)]
    parsed = tables.parse_json(frame(spark, [('{"k": 1}',), ("{bad",), (" ",), (None,)], "j string"), "j", "k int")
    assert [r["problem"] for r in parsed.collect()] == [None, "malformed", "empty", "empty"]
    good, bad = tables.parse_names(frame(spark, [("a-1.jpg",), ("zz",), (None,)], "f string"), "f", r"([a-z])-(\d)\.jpg", ["letter", "digit"])
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(ValueError):
        tables.load(spark, "/root/testdata/sf0.001/nation.parquet", "n_nationkey int, other string")


def test_stream_replay_adds_nothing(spark, tmp_path):
    src, home = str(tmp_path / "in"), str(tmp_path / "state")
    df = frame(spark, [(k % 5, k) for k in range(20)], "k long, v long").coalesce(1)
    df.write.parquet(src)
    first = streams.run_to_end(streams.first_of(streams.file_stream(spark, src), ["k"]), "append", checkpoint=home).count()
    df.write.mode("append").parquet(src)  # the same rows once more
    again = streams.run_to_end(streams.first_of(streams.file_stream(spark, src), ["k"]), "append", checkpoint=home)
    assert first == 5 and again.select("k").distinct().count() == 5


def test_stream_states_never_go_back(spark, tmp_path):
    src = str(tmp_path / "in")
    ranks = {"new": 0, "sent": 1, "done": 2}
    frame(spark, [(1, "sent"), (1, "new"), (2, "new")], "k long, s string").coalesce(1).write.parquet(src)
    frame(spark, [(1, "new"), (2, "done")], "k long, s string").coalesce(1).write.mode("append").parquet(src)
    rows = streams.run_to_end(streams.furthest_state(streams.file_stream(spark, src), "k", "s", ranks), "update").collect()
    best = {}
    for r in sorted(rows, key=lambda r: r["batch"]):
        assert ranks[r["s"]] > ranks.get(best.get(r["k"]), -1)
        best[r["k"]] = r["s"]
    assert best == {1: "sent", 2: "done"}
