"""Lexical search of a table of texts with a table of queries: exact ranks by matching positions, from products of blocks that never leave their task."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators.retrieval import terms
from veldt.operators.shared import LARGE_ROWS, written

#: A pack has so many rows or different words of them, whichever comes first; packs of queries are larger, as each meets all packs of documents.
PACK_ROWS, PACK_WORDS, QUERY_WORDS = 16_384, 2_000_000, 4_000_000
#: A word goes through the dense product if more than one in so many pairs have it on both sides; at most so many words do.
DENSE_SHARE, DENSE_WORDS = 300, 2048
#: Queries of one dense product.
AT_ONCE = 256
#: Packs of more documents have a quarter of so many, the longest ones, looked at first; the best hits of so many queries are remembered.
LONGEST, STATES = 2048, 65_536
#: Documents are dealt to so many tasks at most, and a task brings together what its pairs of packs found, up to so many rows: what it lets out doesn't grow with the documents.
TASKS, HELD_ROWS, OUT_ROWS = 32, 6_000_000, 65_536


def _packs(rows: DataFrame, name: str, most_rows: int, most_words: int) -> DataFrame:
    """Rows (key, words) of unique keys as a table of packs: keys in order, the different words, how many rows have each, and by word these rows and their counts.

    Packs are made where the rows are, several of a task. Rows without words go.
    """
    kind = rows.schema[0].dataType.simpleString()
    schema = f"{name} array<{kind}>, words array<string>, df array<int>, row array<int>, n array<int>"

    def counted(some: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(row, word, count) of each different word of each row."""
        sizes = pc.fill_null(some.column(1).value_lengths(), 0).to_numpy(zero_copy_only=False)
        words = some.column(1).flatten().dictionary_encode()
        span = max(len(words.dictionary), 1)
        group, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * span + words.indices.to_numpy(), return_counts=True)
        return group // span, words.dictionary.take(pa.array(group % span)).cast(pa.string()), n

    def pack(parts: list[tuple]) -> pa.RecordBatch:
        keys = pa.concat_arrays([k for k, *_ in parts])
        order = pc.sort_indices(keys, null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        firsts = np.cumsum([0, *[len(k) for k, *_ in parts]])
        row = place[np.concatenate([r + f for (_, r, _, _), f in zip(parts, firsts)])]
        words = pa.concat_arrays([w for _, _, w, _ in parts]).dictionary_encode()
        n = np.concatenate([x for *_, x in parts])
        code = words.indices.to_numpy().astype(np.int64)
        by = np.argsort(code * len(order) + row)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        numbers = [np.bincount(code, minlength=len(words.dictionary)), row[by], n[by]]
        return pa.RecordBatch.from_arrays([one(keys.take(pa.array(order))), one(words.dictionary), *[one(pa.array(x, pa.int32())) for x in numbers]], [name, "words", "df", "row", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, words = [], 0, 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                row, word, n = counted(some)
                here, row = np.unique(row, return_inverse=True)
                if parts and (rows + len(here) > most_rows or words + len(n) > most_words):
                    yield pack(parts)
                    parts, rows, words = [], 0, 0
                if len(here):
                    parts.append((some.column(0).take(pa.array(here)), row, word, n))
                    rows, words = rows + len(here), words + len(n)
        if parts:
            yield pack(parts)

    return rows.mapInArrow(run, schema)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row of each value, values) of lists without nulls."""
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten()


class _Block:
    """A pack of documents beside one of queries; documents are numbered in the order of their keys. ``state`` is what a task keeps from pair to pair."""

    def __init__(self, pair: dict[str, pa.Array], state: dict | None = None):
        self.state = {} if state is None else state
        number = lambda name: pair[name].to_numpy(zero_copy_only=False).astype(np.int64)
        self.keys, self.q = pair["c"], pair["q"]
        self.docs, self.queries, self.words = len(self.keys), len(self.q), len(pair["words"])
        self.doc, self.n, self.df = number("row"), number("n"), number("df")
        self.starts = np.append(0, np.cumsum(self.df))
        known = pc.fill_null(pc.index_in(pair["q_words"], value_set=pair["words"]), -1).to_numpy()
        word, query = np.repeat(known, number("q_df")), number("q_row")
        met = np.flatnonzero(word >= 0)
        met = met[np.argsort(query[met], kind="stable")]
        self.query, self.query_word = query[met], word[met].astype(np.int64)
        self.ends = np.searchsorted(self.query, np.arange(self.queries + 1))
        self.origin, self.frequent = np.arange(self.docs), None

    def part(self, some: np.ndarray) -> _Block:
        """The block with only those documents that ``some`` is true for; ``origin`` has their numbers here."""
        out = copy.copy(self)
        here = some[self.doc]
        out.doc, out.n = (np.cumsum(some) - 1)[self.doc[here]], self.n[here]
        out.df = np.bincount(np.repeat(np.arange(self.words), self.df)[here], minlength=self.words)
        out.starts, out.docs = np.append(0, np.cumsum(out.df)), int(some.sum())
        out.origin, out.frequent = self.origin[some], None
        return out

    def lengths(self) -> np.ndarray:
        """Positions of each document: it can't have more hits."""
        return np.bincount(self.doc, self.n, minlength=self.docs)

    def _frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word in the dense product or -1, the product's right side, counts of all postings)."""
        if self.frequent is None:
            many = self.df * np.bincount(self.query_word, minlength=self.words)
            frequent = np.flatnonzero(many * DENSE_SHARE > self.docs * self.queries)
            frequent = frequent[np.argsort(-many[frequent], kind="stable")[:DENSE_WORDS]]
            column = np.full(self.words, -1)
            column[frequent] = np.arange(len(frequent))
            # sums below 2 ** 24 are exact in single precision
            right = np.zeros((len(frequent), self.docs), np.float32 if self.lengths().max(initial=0) < 1 << 24 else np.float64)
            for i, w in enumerate(frequent.tolist()):
                own = slice(self.starts[w], self.starts[w + 1])
                right[i, self.doc[own]] = self.n[own]
            self.frequent = column, right, self.n.astype(np.float64)
        return self.frequent

    def hits(self, queries: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(number of a query, positions of each document that match any of its words): frequent words by a dense product, the others one by one."""
        queries = np.arange(self.queries) if queries is None else queries
        column, right, n = self._frequent()
        for first in range(0, len(queries), AT_ONCE):
            some = queries[first : first + AT_ONCE]
            words = [self.query_word[self.ends[i] : self.ends[i + 1]] for i in some]
            left = np.zeros((len(some), len(right)), right.dtype)
            for i, own in enumerate(words):
                at = column[own]
                left[i, at[at >= 0]] = 1
            product = left @ right
            for k, i in enumerate(some.tolist()):
                own = words[k][column[words[k]] < 0]
                sizes = self.df[own]
                entries = np.repeat(self.starts[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                yield i, product[k] + np.bincount(self.doc[entries], n[entries], self.docs)


def _kth(row: np.ndarray, k: int) -> float:
    return np.partition(row, -k)[-k] if k <= len(row) else 0


def _best(block: _Block, k: int) -> pa.Table:
    """The rows of a pack that may be among the ``k`` best of a query. The state has the most hits that the task has met: a document with fewer positions than the k-th of them can't be."""
    names, lengths, state = block.q.to_pylist(), block.lengths(), block.state
    least = np.array([state[q].min() if q in state and len(state[q]) >= k else 0 for q in names], np.float64)
    if not least.any() and block.docs > max(4 * k, LONGEST):  # the longest documents tell how many hits are needed
        for i, row in block.part(lengths >= _kth(lengths, max(2 * k, LONGEST // 4))).hits():
            least[i] = _kth(row, k)
    which, docs, hits = [], [], []
    order, now = np.argsort(least, kind="stable"), block
    for first in range(0, block.queries, AT_ONCE):
        some = order[first : first + AT_ONCE]
        long = lengths[now.origin] >= least[some[0]]
        if long.sum() < 0.6 * now.docs:
            now = now.part(long)
        for i, row in now.hits(some):
            kth = max(_kth(row, k), least[i], 1)
            found = np.flatnonzero(row >= kth)
            if len(found) > k:  # of those that tie with the k-th the first keys
                above = row[found] > kth
                found = np.sort(np.append(found[above], found[~above][: k - above.sum()]))
            which.append(np.full(len(found), i))
            docs.append(now.origin[found])
            hits.append(row[found])
    if len(state) > STATES:
        state.clear()
    for i, row in zip(np.concatenate([x[:1] for x in which]).tolist() if which else [], [x for x in hits if len(x)]):
        met = np.append(state.get(names[i], ()), row)
        state[names[i]] = np.partition(met, -k)[-k:] if len(met) > k else met
    return _rows(block, which, block.keys.take(pa.array(np.concatenate([np.zeros(0, np.int64), *docs]))), {"hits": hits})


def _rows(block: _Block, which: list[np.ndarray], keys: pa.Array, more: dict[str, list[np.ndarray]]) -> pa.Table:
    flat = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))
    return pa.table({"q": block.q.take(flat(which)), "c": keys, **{name: flat(parts) for name, parts in more.items()}})


def _own(block: _Block, picked: pa.ListArray) -> pa.Table:
    """The hits of the picked pairs whose document is here, if there are any."""
    query, keys = _flat(picked)
    at = pc.index_in(keys, value_set=block.keys)
    here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    query, doc = query[here], at.take(pa.array(here)).to_numpy()
    order = np.argsort(block.doc, kind="stable")
    word, n = np.repeat(np.arange(block.words), block.df)[order], block.n[order]
    starts = np.searchsorted(block.doc[order], np.arange(block.docs + 1))
    hits, wanted = np.zeros(len(doc), np.int64), np.zeros(block.words, bool)
    firsts = np.searchsorted(query, np.arange(block.queries + 1))
    for i in np.unique(query):
        words = block.query_word[block.ends[i] : block.ends[i + 1]]
        wanted[words] = True
        own = slice(firsts[i], firsts[i + 1])
        sizes = starts[doc[own] + 1] - starts[doc[own]]
        entries = np.repeat(starts[doc[own]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        hits[own] = np.bincount(np.repeat(np.arange(len(sizes)), sizes), n[entries] * wanted[word[entries]], len(sizes))
        wanted[words] = False
    some = np.flatnonzero(hits)
    return _rows(block, [query[some]], block.keys.take(pa.array(doc[some])), {"hits": [hits[some]]})


def _before(block: _Block, picked: pa.ListArray, scores: pa.ListArray) -> pa.Table:
    """For each picked pair with its hits, how many documents here go before it, added to what the state has of the query pack; rows only if it holds too many."""
    query, keys = _flat(picked)
    score = _flat(scores)[1].to_numpy()
    rank = pc.rank(pa.concat_arrays([block.keys, keys]), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    most = int(rank.max(initial=0)) + 1
    later = most - 1 - rank
    mine = score * most + later[block.docs :]
    ends = np.searchsorted(query, np.arange(block.queries + 1))
    pack = block.q[0].as_py()
    if pack not in block.state:  # copies, as the lists belong to a batch of many megabytes
        block.state[pack] = block.q.take(pa.array(query)), keys.take(pa.array(np.arange(len(keys)))), np.zeros(len(query), np.int64)
    n = block.state[pack][2]
    for i, row in block.hits():
        own = np.arange(ends[i], ends[i + 1])
        own = own[np.argsort(mine[own])]
        counts = np.bincount(np.searchsorted(mine[own], row.astype(np.int64) * most + later[: block.docs]), minlength=len(own) + 1)
        n[own] += block.docs - np.cumsum(counts)[: len(own)]
    if sum(len(x) for *_, x in block.state.values()) > HELD_ROWS:
        return _counted(block.state)
    return _rows(block, [], block.keys[:0], {"n": []})


def _counted(state: dict) -> pa.Table:
    """The counts of a state, which is empty then."""
    parts = [pa.table({"q": q, "c": c, "n": n}) for q, c, n in state.values()]
    state.clear()
    return pa.concat_tables(parts)


def _first(found: pa.Table, k: int) -> pa.Table:
    """Of each query the ``k`` best rows (q, c, hits)."""
    code = pc.fill_null(found["q"].combine_chunks().dictionary_encode().indices, -1)
    order = pc.sort_indices(pa.table({"q": code, "hits": found["hits"], "c": found["c"]}), [("q", "ascending"), ("hits", "descending"), ("c", "ascending")], null_placement="at_start")
    code = code.to_numpy(zero_copy_only=False)[order.to_numpy()]
    starts = np.flatnonzero(np.diff(code, prepend=-2))
    place = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
    return found.take(order.filter(pa.array(place < k)))


class LexicalSearch:
    """A search of ``corpus`` with ``queries`` by hits, the positions of a document that match any word of the query; ties by key.

    Texts become packs of different words with counts. Every pack of queries meets every pack of documents as one pair of rows, which
    a task multiplies, and it lets out only what is asked for: the best rows of each query, or counts for picked ones. Pairs of
    queries and documents are all looked at, but never written or shuffled, and neither are texts. ``analyse`` makes the words of a
    text; ``functions.stems.analysed`` brings English words to their stems without stop words. Documents or queries whose rows share an id count as one.
    """

    def __init__(self, corpus: DataFrame, queries: DataFrame, key: str, query: str, text: str, query_text: str, analyse: Callable[[Column], Column] = terms):
        self.key, self.query = key, query
        rows = corpus.select(F.col(key).alias("c"), analyse(F.col(text)).alias("words"))
        again = written(rows.groupBy("c").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("c").alias("__c")), "again")
        if not again.isEmpty():
            same = F.col("c").eqNullSafe(F.col("__c"))
            rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").groupBy("c").agg(F.flatten(F.collect_list("words")).alias("words")))
        self.docs = written(_packs(rows, "c", PACK_ROWS, PACK_WORDS), "packs", LARGE_ROWS)
        words = queries.select(F.col(query).alias("q"), F.array_distinct(analyse(F.col(query_text))).alias("words")).where(F.size("words") > 0)
        self.asked = written(words.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")), "asked")

    def _met(self, run: Callable[[_Block, dict], pa.Table], result: str, picked: DataFrame | None = None, fewer: Callable[[pa.Table], pa.Table] | None = None, rest: Callable[[dict], pa.Table] | None = None) -> DataFrame:
        """``run`` of each pair of packs; rows (q, c, result). Lists of ``picked``, rows (q, lists), stand beside their queries. ``fewer`` brings together what a task found, ``rest`` is what its state holds at the end."""
        # full packs: each query pack beyond need sends the documents to Python once more
        n = self.asked.agg(F.greatest(F.count(F.lit(1)) / PACK_ROWS, F.sum(F.size("words")) / QUERY_WORDS)).first()[0]
        packed = written(_packs(self.asked.coalesce(int(n or 0) + 1), "q", PACK_ROWS, QUERY_WORDS), "packs", LARGE_ROWS)
        names = ["words", "df", "row"]
        beside = packed.select("q", *[F.col(x).alias(f"q_{x}") for x in names])
        kinds = self.docs.schema["c"].dataType.elementType.simpleString(), packed.schema["q"].dataType.elementType.simpleString()
        if picked is not None:
            # a list of each query of a pack in their order, empty without picks
            at = beside.withColumn("__pack", F.monotonically_increasing_id())
            at = written(at, "packs", LARGE_ROWS)
            each = at.select("__pack", F.posexplode("q").alias("__at", "__q")).join(picked, F.col("__q").eqNullSafe(F.col("q")), "left")
            lists = each.groupBy("__pack").agg(F.array_sort(F.collect_list(F.struct("__at", *[F.coalesce(x, F.array().cast(picked.schema[x].dataType)).alias(x) for x in picked.columns[1:]]))).alias("w"))
            beside = written(at.join(lists, "__pack").select("q", *[f"q_{x}" for x in names], *[F.col(f"w.{x}").alias(x) for x in picked.columns[1:]]), "packs", LARGE_ROWS)

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows, state = [], 0, {}
            for batch in batches:
                for i in range(batch.num_rows):
                    pair = {name: batch.column(k)[i].values for k, name in enumerate(batch.schema.names)}
                    found = run(_Block(pair, state), pair)
                    if fewer is None:
                        yield from found.to_batches()
                        continue
                    held, rows = [*held, found], rows + len(found)
                    if rows > HELD_ROWS:
                        held = [fewer(pa.concat_tables(held))]
                        rows = len(held[0])
                        if rows > HELD_ROWS * 3 // 4:
                            yield from held[0].to_batches(OUT_ROWS)
                            held, rows = [], 0
            if held:
                yield from fewer(pa.concat_tables(held)).to_batches(OUT_ROWS)
            if rest is not None and state:
                yield from rest(state).to_batches(OUT_ROWS)

        # packs of queries are read where documents are: a broadcast would grow with their lists up to many times what their files take
        return self.docs.coalesce(TASKS).crossJoin(beside.hint("shuffle_replicate_nl")).mapInArrow(met, f"q {kinds[1]}, c {kinds[0]}, {result} long")

    def topk(self, k: int) -> DataFrame:
        """Rows (query, key, hits, rank): the ``k`` documents with most hits of each query, ties by key."""
        best = self._met(lambda block, _: _best(block, k), "hits", fewer=lambda found: _first(found, k))
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("hits").desc(), "c"))).where(F.col("rank") <= k)
        return ranked.select(F.col("q").alias(self.query), F.col("c").alias(self.key), "hits", "rank")

    def ranks(self, picked: DataFrame) -> DataFrame:
        """Rows (query, key, hits, rank): the rank among all documents that each pair (query, key) of ``picked`` has; pairs without hits have none."""
        pairs = picked.select(F.col(self.query).alias("q"), F.col(self.key).alias("c")).where("q IS NOT NULL AND c IS NOT NULL").distinct()
        lists = lambda df, *names: df.groupBy("q").agg(F.collect_list(F.struct(*names)).alias("w")).select("q", *[F.col(f"w.{x}").alias(f"w_{x}") for x in names])
        scored = written(self._met(lambda block, pair: _own(block, pair["w_c"]), "hits", lists(pairs, "c")), "scored")
        counted = self._met(lambda block, pair: _before(block, pair["w_c"], pair["w_hits"]), "n", lists(scored, "c", "hits"), rest=_counted)
        ranked = counted.groupBy("q", "c").agg((F.sum("n") + 1).alias("rank")).join(scored.hint("merge"), ["q", "c"])
        return ranked.select(F.col("q").alias(self.query), F.col("c").alias(self.key), "hits", "rank")


def lexical_topk(corpus: DataFrame, queries: DataFrame, key: str, query: str, text: str, query_text: str, k: int, analyse: Callable[[Column], Column] = terms) -> DataFrame:
    """Rows (query, key, hits, rank): the ``k`` documents with most positions that match any word of the query, ties by key."""
    return LexicalSearch(corpus, queries, key, query, text, query_text, analyse).topk(k)
