"""Queries that prepare data sets: splits, folds, components, suppression, near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import preparation as P
from veldt.operators.evaluation import rates_at
from veldt.operators.stats import percentiles
from veldt.plans.registry import Registry

R = Registry()
MARK = "('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 13))::BIGINT"


def split(t):
    return P.group_split(t("documents").select("doc_id", "source", "lang", "n_chars"), "source", "lang", 0.2, 42)


SPLIT = f"""
z AS (SELECT source, count(*) AS n, min(lang) AS stratum, {MARK.format(seed=42, key="source")} AS mark FROM documents GROUP BY source),
o AS (SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY mark) AS upto, round(sum(n) OVER (PARTITION BY stratum) * 0.2) AS quota FROM z),
h AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, upto - n / 2 <= quota AS held FROM documents d JOIN o ON o.source = d.source)
"""


@R.query("group_split", f"WITH {SPLIT} SELECT doc_id, held FROM h")
def _(t):
    return split(t).select("doc_id", "held")


@R.query("split_leakage", "SELECT source, count(DISTINCT lang) AS n_splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def _(t):
    return P.leaks(t("documents"), "source", "lang")


@R.query("split_statistics", f"""
WITH {SPLIT} SELECT held, count(*) AS n_values, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.1), 4) AS p10, round(quantile_cont(n_chars, 0.9), 4) AS p90 FROM h GROUP BY held
""")
def _(t):
    found = percentiles(split(t), ["held"], "n_chars", {"p50": 0.5, "p10": 0.1, "p90": 0.9})
    return found.select("held", "n_values", *[F.round(f"{p}_linear", 4).alias(p) for p in ("p50", "p10", "p90")])


@R.query("stratified_folds", f"SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY {MARK.format(seed=7, key='doc_id')}) - 1) % 5 AS fold FROM labels")
def _(t):
    return P.folds(t("labels").select("doc_id", "quality"), "doc_id", "quality", 5, 7).select("doc_id", "fold")


@R.query("fold_accuracy", f"""
WITH f AS (SELECT l.doc_id, toxic, d.n_chars / 20000.0::DOUBLE AS score, (row_number() OVER (PARTITION BY quality ORDER BY {MARK.format(seed=7, key='l.doc_id')}) - 1) % 5 AS fold FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT fold, count(*) AS n, round(count(*) FILTER (WHERE (score >= 0.1) = (toxic = 1)) / count(*), 6) AS accuracy FROM f GROUP BY fold
""")
def _(t):
    folded = P.folds(t("labels"), "doc_id", "quality", 5, 7).join(t("documents").select("doc_id", (F.col("n_chars") / 20000).alias("score")), "doc_id")
    return rates_at(folded, "toxic", "score", 0.1, ["fold"]).select("fold", "n", F.round("accuracy", 6).alias("accuracy"))


def order_part_components(lines):
    """Orders (even nodes) and parts (odd nodes) that lines link."""
    return P.components(lines.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")), "a", "b")


@R.query("connected_components")
def _(t):
    return order_part_components(t("lineitem"))


@R.query("connected_components_whole")
def _(t):
    return order_part_components(t("lineitem"))


@R.query("greedy_suppression", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + (value * 60000000)::BIGINT AS b, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events),
k(user_id, rn, kept) AS (SELECT user_id, 1, [{'id': event_id, 'a': a, 'b': b}] FROM e WHERE rn = 1
  UNION ALL SELECT k.user_id, k.rn + 1, CASE WHEN len(list_filter(kept, lambda x: e.a < x.b AND e.b > x.a)) = 0 THEN list_append(kept, {'id': event_id, 'a': e.a, 'b': e.b}) ELSE kept END
  FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
SELECT user_id, unnest(list_transform(kept, lambda x: x.id)) AS event_id FROM (SELECT user_id, arg_max(kept, rn) AS kept FROM k GROUP BY user_id)
""")
def _(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t("events").select("user_id", "event_id", at.alias("a"), (at + (F.col("value") * 60_000_000).cast("long")).alias("b"), "value")
    return P.suppress(rows, "user_id", "a", "b", "value", "event_id").select("user_id", "event_id")


@R.query("near_duplicates", r"""
WITH RECURSIVE w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w),
f AS (SELECT min(doc_id) AS doc_id, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s), x AS (SELECT doc_id, n, unnest(s) AS token FROM f),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= (a.n + b.n - count(*)) * 0.8),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM f), t(a, c) AS (SELECT a, b FROM u UNION SELECT t.a, u.b FROM t JOIN u ON u.a = t.c),
c AS (SELECT a, min(c) AS c FROM t GROUP BY a)
SELECT s.doc_id, c.c AS cluster FROM s JOIN f ON f.s = list_sort(s.s) JOIN c ON c.a = f.doc_id
""")
def _(t):
    return P.near_duplicates(t("documents"), "doc_id", "text")


@R.query("requirement_trace", """
SELECT p_brand, count(l_partkey) AS n_sold FROM (SELECT DISTINCT p_brand, p_partkey FROM part) p LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') l ON l_partkey = p_partkey GROUP BY p_brand
""")
def _(t):
    sold = t("lineitem").where("l_returnflag = 'R'").select("l_partkey").distinct()
    return t("part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_brand").agg(F.count("l_partkey").alias("n_sold"))
