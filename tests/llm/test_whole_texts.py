"""Cases in which the training-data operators lost text."""

import pytest

from tests.llm.common import DOCS, prose
from veldt.llm import html_text, simhash_links


@pytest.mark.parametrize(
    "page,want",
    [
        ('<p>one</p><svg class="i"/><p>two</p>', ["one", "two"]),
        ("<p>one</p><svg/><p>two</p><svg><text>no</text></svg><p>three</p>", ["one", "two", "three"]),
        ("<p>one <math alt='a>b' /> two</p>", ["one two"]),
        ("<title-bar>one</title-bar><p>two</p>", ["one", "two"]),
        ("<template-x a=1>one</template-x><p>two</p>", ["one", "two"]),
        ("<title>no</title><script src='a'/>no</script><SVG a=1>no</SVG ><style\n>no</style><p>two</p>", ["two"]),
    ],
)
def test_only_hidden_elements_hide_text(page, want):
    assert [b.text for b in html_text.blocks_of(page)] == want


def test_a_key_on_two_texts_loses_only_the_copy(spark):
    a, b, c, d = (prose(seed, 300) for seed in range(4))
    near = a + " end"
    assert 0 < (simhash_links.fingerprint(a.encode()) ^ simhash_links.fingerprint(near.encode())).bit_count() <= 4
    rows = [(1, a), (5, near), (5, b), (6, a), (6, c), (6, c), (7, b), (8, d), (None, a), (9, None), (9, d)]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)
    kept = [(x["doc_id"], x["text"]) for x in simhash_links.keep_first(df).collect()]
    want = [(1, a), (5, b), (6, c), (6, c), (8, d), (None, a), (9, None)]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
