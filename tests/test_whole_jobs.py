"""Queries without a SQL twin against plain Python on small fixtures that hold the cases a cut would lose."""

import hashlib
import random
import re
from collections import Counter
from datetime import datetime
from fractions import Fraction

import pytest

from tests.test_operators import plain_components
from veldt.functions import stems
from veldt.operators import retrieval
from veldt.plans import catalog


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """260 documents of several lines, all with vectors and most with labels; queries are the rows 0, 100 and 200."""
    r = random.Random(11)
    home = tmp_path_factory.mktemp("corpus")
    words = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(260):
        lines = [" ".join(r.choices(words, k=r.randrange(1, 12))) for _ in range(r.randrange(1, 6) + 2 * (k % 100 == 0))]
        text = "\n".join(lines)
        docs.append((k, text, r.choice(["en", "fr", "de", "es"]), f"s{k % 3}", len(text) * r.choice([1, 40])))
    vectors = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(260)]
    labels = [(k, r.randrange(2), r.randrange(2)) for k in range(260) if k % 40]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{home}/embeddings.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home), docs, vectors, labels


def lexical_order(docs):
    """{query: [(doc, hits), ...]} in the order of the ranks, over the whole texts of both."""
    found = {k: Counter(re.findall("[a-z0-9]+", text.lower())) for k, text, *_ in docs}
    out = {}
    for q in (k for k in found if k % 100 == 0):
        hits = {k: sum(n for w, n in c.items() if w in found[q]) for k, c in found.items()}
        out[q] = sorted(((k, n) for k, n in hits.items() if n), key=lambda x: (-x[1], x[0]))
    return out


def missing_of(docs, labels):
    quality = {k: q for k, q, _ in labels}
    return {k: [f for f in ("de", "es") if f == lang] + ["quality"] * (quality.get(k) == 0) for k, _, lang, _, _ in docs}


def test_lexical_search_uses_the_whole_query_text(spark, corpus):
    home, docs, _, labels = corpus
    order, missing = lexical_order(docs), missing_of(docs, labels)
    rows = lambda name: sorted(map(tuple, catalog.queries()[name](spark, home).collect()))
    want = sorted((q, k, n, i + 1) for q, found in order.items() for i, (k, n) in enumerate(found[:20]))
    assert rows("lexical_topk_whole") == want == rows("lexical_topk")
    gated = {q: [x for x in found if not missing[x[0]]][:5] for q, found in order.items()}
    assert rows("gated_search_whole") == sorted((q, k, n, i + 1) for q, found in gated.items() for i, (k, n) in enumerate(found))
    assert rows("withheld_matches_whole") == sorted((q, k, ",".join(missing[k])) for q, found in order.items() for k, _ in found[:5] if missing[k])


STEMS = {
    "consigned": "consign", "consistency": "consist", "consistently": "consist", "knightly": "knight", "generously": "generous", "nationally": "nation", "running": "run", "happiness": "happi",
    "relational": "relat", "hopping": "hop", "hoping": "hope", "skies": "sky", "dying": "die", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre",
    "feed": "feed", "luxuriated": "luxuri", "luxuriate": "luxuri", "cry": "cri", "by": "by", "say": "say", "inning": "inning", "communism": "communism", "adjustable": "adjust",
    "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate", "controlling": "control", "roll": "roll", "bed": "bed", "shred": "shred", "it's": "it", "youth": "youth",
    "hopefulness": "hope", "analogously": "analog", "sensibilities": "sensibl", "formative": "format", "triplicate": "triplic",
}


def test_stems_of_published_samples():
    assert {w: stems.stem(w) for w in STEMS} == STEMS


def test_stemmed_search(spark, tmp_path):
    docs = [(0, "the runner was running and hoping"), (1, "He runs. Runs!"), (2, "the and was"), (3, "hope"), (4, None), (5, "hopeful run")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, catalog.queries()["lexical_topk_stemmed"](spark, str(tmp_path)).select("query_id", "doc_id", "hits", "rank").collect()))
    assert found == [(0, 0, 3, 1), (0, 1, 2, 2), (0, 5, 2, 3), (0, 3, 1, 4)][:1] + [(0, 1, 2, 2), (0, 3, 1, 4), (0, 5, 2, 3)]


def fused_order(docs, vectors):
    """{query: [(doc, dense rank, lexical rank), ...]}: the 20 best of the whole pool, both sides ranked without a cut."""
    import numpy as np

    v = np.array([x for _, x in vectors], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for q, found in lexical_order(docs).items():
        s = np.round(v @ v[q], 9)
        dense = {int(k): i + 1 for i, k in enumerate(np.lexsort((np.arange(len(v)), -s)))}
        lexical = {k: i + 1 for i, (k, _) in enumerate(found)}
        one = lambda r: Fraction(1, 60 + r) if r else 0
        best = sorted(dense.keys() | lexical.keys(), key=lambda k: (-(one(dense.get(k)) + one(lexical.get(k))), k))
        out[q] = [(k, dense.get(k), lexical.get(k)) for k in best[:20]]
    return out


def test_fusion_knows_ranks_beyond_the_candidates(spark, corpus):
    home, docs, vectors, labels = corpus
    order = fused_order(docs, vectors)
    rows = lambda name: sorted(map(tuple, catalog.queries()[name](spark, home).collect()))
    assert any(max(d, x or 0) > 100 for found in order.values() for _, d, x in found)
    assert rows("hybrid_fusion_whole") == sorted((q, k, d, x, i + 1) for q, found in order.items() for i, (k, d, x) in enumerate(found))
    scores = {k: quality - toxic * 0.5 for k, quality, toxic in labels}
    want = []
    for q, found in order.items():
        top = [k for k, _, _ in found[:5]]
        done = all(k in scores for k in top)
        want += [(q, k, done, i + 1) for i, k in enumerate(sorted(top, key=lambda k: -scores[k]) if done else top)]
    assert rows("rerank_all_or_nothing_whole") == sorted(want)
    lang = {k: x for k, _, x, _, _ in docs}
    tags = {q: [k for s in ("en", "de", "fr", "es") for k in [k for k, _, _ in found if lang[k] == s][:5]] for q, found in order.items()}
    assert rows("deliver_tags_whole") == sorted((q, k, lang[k], f"S{i + 1}") for q, found in tags.items() for i, k in enumerate(found))


def test_fusion_with_too_few_candidates_raises(spark):
    with pytest.raises(ValueError, match="depth"):
        retrieval.fuse_whole(None, None, None, None, "q", "id", "v", 20, 99)


def test_components_take_all_lines(spark, tmp_path):
    r = random.Random(4)
    lines = [(r.randrange(1, 90), r.randrange(1, 60), float(r.randrange(1, 51)), r.randrange(11) / 100) for _ in range(70)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {x["node"]: x["component"] for x in catalog.queries()["connected_components_whole"](spark, str(tmp_path)).collect()}
    assert found == plain_components([(2 * o, 2 * p + 1) for o, p, _, _ in lines])
    assert len(found) == catalog.queries()["connected_components"](spark, str(tmp_path)).count()


def test_ratios_and_states_take_all_events(spark, tmp_path):
    r = random.Random(5)
    states = ["signup", "view", "click", "purchase", "error"]
    rows = [(k, r.randrange(12), r.choice(states), datetime(2024, 1, r.randrange(1, 28)), r.uniform(0, 80)) for k in range(60)]
    rows += [(60, 50, "view", datetime(2024, 1, 9), 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    kinds = {}
    for _, user, kind, *_ in rows:
        kinds.setdefault(user, []).append(kind)
    shares = {u: round(k.count("error") / n, 6) if (n := k.count("error") + k.count("signup")) else None for u, k in kinds.items()}
    assert {x["user_id"]: x["failure_share"] for x in catalog.queries()["guarded_ratio_whole"](spark, str(tmp_path)).collect()} == shares
    moves = {(u, max(k, key=states.index), len(set(k))) for u, k in kinds.items()}
    assert set(map(tuple, catalog.queries()["state_machine_fold_whole"](spark, str(tmp_path)).collect())) == moves


def test_documents_are_scrubbed_by_all_rules(spark, tmp_path):
    texts = [
        "Seen by Dr. Silva and Ms Anna Perera",
        "MRN: A-1234, NIC 123456789V",
        "mail a.b@c.org on 12/03/2024, 2024-3-4, 3 Mar 2024 or Mar 3, 2024",
        "call +94 77 123 4567 or 4111-1111-1111-1111, not 12.3456789",
        "සිල්වා මහත්මිය", "පෙරේරා මහතාට වේදනාව", "திரு குமார் வலி, திருமதி லதா", "nothing here", "", None,
    ]
    want = [
        ("Seen by [name removed] and [name removed]", ["name"]),
        ("[ID removed], [ID removed]", ["identifier"]),
        ("mail [email removed] on [date removed], [date removed], [date removed] or [date removed]", ["email", "date"]),
        ("call [number removed] or [number removed], not 12.3456789", ["number"]),
        ("[name removed]", ["name"]), ("[name removed]ට වේදනාව", ["name"]), ("[name removed] வலி, [name removed]", ["name"]), ("nothing here", []), ("", []),
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {x["doc_id"]: x for x in catalog.queries()["pii_scrub_whole"](spark, str(tmp_path)).collect()}
    assert len(found) == len(texts) and found[9]["scrubbed"] is None
    for k, (text, kinds) in enumerate(want):
        assert found[k]["kinds"] == kinds and found[k]["scrubbed"] == hashlib.sha256(text.encode()).hexdigest()


def test_line_join_keeps_hyphenated_and_null_texts(spark, tmp_path):
    texts = {1: ("a hyphen-\nated line\n\nand Non-\nEnglish", "a hyphenated line and Non- English"), 2: ("pre-\nWar", "pre- War"), 3: ("é-\nà x-\n- y", "éà x- - y"), 4: ("plain\nlines", "plain lines"), 5: ("", "")}
    rows = [(k, text) for k, (text, _) in texts.items()] + [(6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = dict(map(tuple, catalog.queries()["line_join"](spark, str(tmp_path)).collect()))
    assert found == {k: hashlib.sha256(want.encode()).hexdigest() for k, (_, want) in texts.items()} | {6: None}
