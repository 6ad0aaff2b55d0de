"""Queries of hybrid retrieval. Queries are the rows whose id is divisible by 100; they run against all rows.

Lexical queries search with every word of a query document, fusion knows all ranks of both sides. The names that end in ``_whole``
are kept from a time when the others did less; they give the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import stems, vectors
from veldt.operators import joins, lexical, retrieval
from veldt.plans.registry import Registry

R = Registry()
K = 20
EVERY = 100
FIELDS = ["en", "fr", "de", "es", "long", "quality"]


def asked(t):
    return t("embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def asked_text(t):
    return t("documents").where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("q"))


DENSE = f"""
d AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS cosine FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM d)
"""
LEX = f"""
qt AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE doc_id % {EVERY} = 0),
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
x AS (SELECT query_id, doc_id, count(*) AS hits FROM dt JOIN qt USING (term) GROUP BY 1, 2),
xr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM x)
"""
FUSED = f"""
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS dense_rank, b.rank AS lexical_rank,
  round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 15) AS score FROM dr a FULL JOIN xr b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
"""


def hybrid(t):
    corpus = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    dense = retrieval.dense_topk(corpus, asked(t), "doc_id", "query_id", "embedding", 100)
    search = lexical.LexicalSearch(t("documents"), asked_text(t), "doc_id", "query_id", "text", "q")
    return retrieval.fuse_whole(dense, search, corpus, asked(t), "query_id", "doc_id", "embedding", K, 100)


@R.query("dense_topk", f"WITH {DENSE} SELECT query_id, doc_id, round(cosine, 6) AS cosine, rank FROM dr WHERE rank <= {K}")
def _(t):
    found = retrieval.dense_topk(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), asked(t), "doc_id", "query_id", "embedding", K)
    return found.withColumns({"cosine": F.round("cosine", 6), "rank": F.col("rank").cast("long")})


@R.query("neighbours_top8", f"""
WITH d AS (SELECT q.vec_id AS a, e.vec_id AS b, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS c FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0 AND q.vec_id <> e.vec_id)
SELECT DISTINCT least(a, b) AS low, greatest(a, b) AS high FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM d) WHERE rn <= 8
""")
def _(t):
    found = retrieval.dense_topk(t("embeddings"), asked(t), "vec_id", "query_id", "embedding", 8, exclude_self=True)
    return found.select(F.least("query_id", "vec_id").alias("low"), F.greatest("query_id", "vec_id").alias("high")).distinct()


@R.query("lexical_topk", f"WITH {LEX} SELECT query_id, doc_id, hits, rank FROM xr WHERE rank <= {K}")
def _(t):
    return lexical.lexical_topk(t("documents"), asked_text(t), "doc_id", "query_id", "text", "q", K).withColumn("rank", F.col("rank").cast("long"))


@R.query("lexical_topk_whole")
def _(t):
    return lexical.lexical_topk(t("documents"), asked_text(t), "doc_id", "query_id", "text", "q", K).withColumn("rank", F.col("rank").cast("long"))


@R.query("lexical_topk_stemmed")
def _(t):
    found = lexical.lexical_topk(t("documents"), asked_text(t), "doc_id", "query_id", "text", "q", K, stems.analysed)
    return found.withColumn("rank", F.col("rank").cast("long"))


@R.query("hybrid_fusion", f"WITH {DENSE}, {LEX}, {FUSED} SELECT query_id, doc_id, dense_rank, lexical_rank, rank FROM fr WHERE rank <= {K}")
def _(t):
    return hybrid(t).select("query_id", "doc_id", *[F.col(c).cast("long").alias(c) for c in ("dense_rank", "lexical_rank", "rank")])


@R.query("hybrid_fusion_whole")
def _(t):
    return hybrid(t).select("query_id", "doc_id", *[F.col(c).cast("long").alias(c) for c in ("dense_rank", "lexical_rank", "rank")])


def gated(t):
    long = F.when(F.col("n_chars") > 2000, F.lit("long"))
    labelled = t("labels").select("doc_id", F.when(F.col("quality") == 0, F.lit("quality")).alias("low"))
    docs = t("documents").select("doc_id", "lang", "n_chars", "source").join(labelled, "doc_id", "left")
    docs = docs.select("doc_id", "source", F.array_compact(F.array("lang", long, "low")).alias("required"))
    return retrieval.gate(docs, "required", ["en", "long", "fr"], FIELDS)


GATED = """
g AS (SELECT d.doc_id, d.source, list_filter(['en', 'fr', 'de', 'es', 'long', 'quality'], lambda f: f NOT IN ('en', 'long', 'fr') AND (f = d.lang OR (f = 'long' AND d.n_chars > 2000) OR (f = 'quality' AND l.quality = 0))) AS missing
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


@R.query("gate_decisions", f"WITH {GATED} SELECT doc_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS admissible FROM g")
def _(t):
    return gated(t).select("doc_id", F.array_join("missing", ",").alias("missing"), "admissible")


@R.query("gate_refusals", f"WITH {GATED} SELECT field, count(*) AS n_blocked, count(*) FILTER (WHERE alone) AS n_unlocked FROM (SELECT unnest(missing) AS field, len(missing) = 1 AS alone FROM g) GROUP BY field")
def _(t):
    return retrieval.refusals(gated(t))


@R.query("next_best", f"""
WITH {GATED} SELECT field, count(*) AS n_blocked, count(*) FILTER (WHERE alone) AS n_unlocked FROM (SELECT unnest(missing) AS field, len(missing) = 1 AS alone FROM g) GROUP BY field ORDER BY n_unlocked DESC, n_blocked DESC, field LIMIT 1
""")
def _(t):
    return retrieval.next_best(retrieval.refusals(gated(t)))


def gated_search(t, queries):
    # the pool is gated first, then ranked
    pool = t("documents").join(gated(t).where("admissible").select("doc_id"), "doc_id", "left_semi")
    return lexical.lexical_topk(pool, queries, "doc_id", "query_id", "text", "q", 5).withColumn("rank", F.col("rank").cast("long"))


def withheld_matches(t, queries):
    # ranked over the whole pool first; what the gate then withholds is told
    best = lexical.lexical_topk(t("documents"), queries, "doc_id", "query_id", "text", "q", 5)
    return best.join(gated(t).where("NOT admissible"), "doc_id").select("query_id", "doc_id", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@R.query("gated_search", f"WITH {LEX}, {GATED}, r AS (SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, x.doc_id) AS rn FROM x JOIN g ON g.doc_id = x.doc_id WHERE len(missing) = 0) SELECT query_id, doc_id, hits, rn AS rank FROM r WHERE rn <= 5")
def _(t):
    return gated_search(t, asked_text(t))


@R.query("gated_search_whole")
def _(t):
    return gated_search(t, asked_text(t))


@R.query("withheld_matches", f"WITH {LEX}, {GATED} SELECT query_id, xr.doc_id, array_to_string(list_sort(missing), ',') AS missing FROM xr JOIN g ON g.doc_id = xr.doc_id WHERE rank <= 5 AND len(missing) > 0")
def _(t):
    return withheld_matches(t, asked_text(t))


@R.query("withheld_matches_whole")
def _(t):
    return withheld_matches(t, asked_text(t))


def reranked(t, found):
    scores = t("labels").select("doc_id", (F.col("quality") - F.col("toxic") * 0.5).alias("score"))
    return retrieval.rerank(found.where("rank <= 5").select("query_id", "doc_id", "rank"), scores, "query_id", "doc_id")


@R.query("rerank_all_or_nothing", f"""
WITH {DENSE}, {LEX}, {FUSED}, s AS (SELECT fr.query_id, fr.doc_id, fr.rank, (quality - toxic * 0.5)::DOUBLE AS sc FROM fr LEFT JOIN labels l ON l.doc_id = fr.doc_id WHERE rank <= 5),
a AS (SELECT *, count(*) FILTER (WHERE sc IS NULL) OVER (PARTITION BY query_id) = 0 AS reranked FROM s)
SELECT query_id, doc_id, reranked, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reranked THEN -sc ELSE 0 END, rank) AS final_rank FROM a
""")
def _(t):
    return reranked(t, hybrid(t)).select("query_id", "doc_id", "reranked", F.col("final_rank").cast("long").alias("final_rank"))


@R.query("rerank_all_or_nothing_whole")
def _(t):
    return reranked(t, hybrid(t)).select("query_id", "doc_id", "reranked", F.col("final_rank").cast("long").alias("final_rank"))


@R.query("rerank_stability", f"""
WITH {DENSE}, p AS (SELECT query_id, doc_id, cosine AS a, round(cosine, 1) + (doc_id * 7919 % 13) / 100.0 AS b FROM dr WHERE rank <= {K})
SELECT x.query_id, count(*) AS n_swapped FROM p x JOIN p y ON x.query_id = y.query_id WHERE x.a - y.a > 0.06 AND x.b < y.b GROUP BY 1
""")
def _(t):
    found = retrieval.dense_topk(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), asked(t), "doc_id", "query_id", "embedding", K)
    runs = found.withColumn("again", F.round("cosine", 1) + (F.col("doc_id") * 7919 % 13) / 100)
    return retrieval.unstable_pairs(runs, "query_id", "doc_id", "cosine", "again", 0.06)


def delivered(t, found):
    placed = found.join(t("documents").select("doc_id", "lang"), "doc_id")
    return retrieval.deliver(placed, ["query_id"], "doc_id", "lang", ["en", "de", "fr", "es"], "rank", 5).select("query_id", "doc_id", "lang", "tag")


@R.query("deliver_tags", f"""
WITH {DENSE}, {LEX}, {FUSED}, s AS (SELECT query_id, d.doc_id, lang, rank, list_position(['en', 'de', 'fr', 'es'], lang) AS place FROM fr JOIN documents d ON d.doc_id = fr.doc_id WHERE rank <= {K}),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY rank, doc_id) AS rn FROM s)
SELECT query_id, doc_id, lang, 'S' || row_number() OVER (PARTITION BY query_id ORDER BY place, rn) AS tag FROM i WHERE rn <= 5
""")
def _(t):
    return delivered(t, hybrid(t))


@R.query("deliver_tags_whole")
def _(t):
    return delivered(t, hybrid(t))


@R.query("idempotent_replay", """
WITH k AS (SELECT o_custkey AS key, min(o_orderpriority) AS fp FROM orders GROUP BY 1) SELECT o_orderkey, CASE WHEN k.key IS NULL THEN 'new' WHEN fp = o_orderpriority THEN 'replay' ELSE 'conflict' END AS status
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN -1 ELSE o_custkey END AS key, o_orderpriority FROM orders) o LEFT JOIN k ON k.key = o.key
""")
def _(t):
    orders = t("orders")
    known = orders.groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderpriority").alias("fp"))
    asked_for = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", F.lit(-1)).otherwise(F.col("o_custkey")).alias("key"), F.col("o_orderpriority").alias("fp"))
    return retrieval.replay_status(asked_for, known, "key", "fp").select("o_orderkey", "status")


@R.query("vector_checks", """
SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.001 THEN 'norm' END AS problem FROM embeddings
""")
def _(t):
    v = F.col("embedding")
    return t("embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), vectors.vector_problem(v, 64, 0.001).alias("problem"))


@R.query("lowest_cosine_by_label", """
WITH f AS (SELECT label, arg_min(embedding, vec_id) AS e0 FROM embeddings WHERE label IS NOT NULL GROUP BY label)
SELECT e.label, round(min(list_cosine_similarity(e0::DOUBLE[], embedding::DOUBLE[])), 6) AS lowest FROM embeddings e JOIN f ON f.label = e.label GROUP BY e.label
""")
def _(t):
    rows = t("embeddings").where("label IS NOT NULL")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e0"))
    return rows.join(first, "label").groupBy("label").agg(F.round(F.min(vectors.cosine(F.col("e0"), F.col("embedding"))), 6).alias("lowest"))


@R.query("vocabulary_check", """
SELECT DISTINCT lang AS value FROM documents WHERE lang NOT IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= (SELECT count(*) / 6 FROM documents))
""")
def _(t):
    docs = t("documents").select("lang")
    common = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(docs.agg((F.count(F.lit(1)) / 6).alias("least")))).where("n >= least")  # one row
    return joins.not_yet(docs.where("lang IS NOT NULL").distinct().withColumnRenamed("lang", "value"), common, "value", "lang")
