"""Queries of annotation by patterns, confirmed mappings, phrases, regions and real word differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import text as X
from veldt.operators import annotation, joins, stats
from veldt.plans.registry import Registry

R = Registry()
#: A small rule set over the words of the test texts.
RULES = annotation.Rules(
    openers=[r"the\b", r"and\b", r"in\b"],
    start=r"\b(?:with|for|that)\b",
    ends=[r"[,:;.!?]", r"\n", r"\s(?:is|are|was|und|est)\b"],
    fields={"place": [r"in\b", r"on\b"], "share": [r"of\b"], "time": [r"when\b", r"th\w*\b"]},
    qualifier=r"\b(?:not|by|or)\b",
    prohibit=[r"(?:is|are) not\b"],
    prohibit_anywhere=r"\bnot\b",
)
CLAUSE = r"(?is)(\b(?:with|for|that)\b.*?)(?:[,:;.!?]|\n|\s(?:is|are|was|und|est)\b|$)"
OPENING = r"(?is)^((?:the\b|and\b|in\b).*?)(?:[,:;.!?]|\n|\s(?:is|are|was|und|est)\b|$)"
#: The two engines see word borders beside other letters than a to z differently, so these stand for one letter here.
FOLDED = r"regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')"


def folded(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))


@R.query("clause_spans", rf"""
WITH c AS (SELECT doc_id, regexp_extract_all(text, '{CLAUSE}', 1) AS c, regexp_extract(text, '{OPENING}', 1) AS o FROM (SELECT doc_id, {FOLDED} AS text FROM documents WHERE text IS NOT NULL))
SELECT doc_id, len(c)::BIGINT AS n_clauses, md5(array_to_string(c, '|')) AS clauses, CASE WHEN o <> '' THEN md5(o) END AS opening FROM c
""")
def _(t):
    found = annotation.annotate(folded(t), "text", RULES)
    return found.select("doc_id", F.size("clauses").cast("long").alias("n_clauses"), F.md5(F.array_join("clauses", "|").cast("binary")).alias("clauses"), F.md5(F.col("opening").cast("binary")).alias("opening"))


def _terms(name):
    return "(?i)(?:" + "|".join(RULES.fields[name]) + ")"


@R.query("clause_fields", rf"""
WITH c AS (SELECT doc_id, text, list_filter(list_prepend(regexp_extract(text, '{OPENING}', 1), regexp_extract_all(text, '{CLAUSE}', 1)), lambda x: x <> '') AS c FROM (SELECT doc_id, {FOLDED} AS text FROM documents WHERE text IS NOT NULL)),
f AS (SELECT doc_id, text, c, list_filter(['place', 'share', 'time'], lambda n: list_bool_or(list_transform(c, lambda p: regexp_matches(regexp_replace(p, '(?i)\b(?:not|by|or)\b(?:\W+\w+){{0,5}}?\W+' || m[n][1] || '(?:(?:\W+\w+){{0,5}}?\W+' || m[n][1] || ')*', ' ', 'g'), '(?i)' || m[n][1])))) AS r,
  list_filter(['place', 'share', 'time'], lambda n: regexp_matches(text, '(?i)' || m[n][1])) AS named
  FROM c, (SELECT MAP {{'place': ['(?:in\b|on\b)'], 'share': ['(?:of\b)'], 'time': ['(?:when\b|th\w*\b)']}} AS m))
SELECT doc_id, array_to_string(r, ',') AS required, array_to_string(list_filter(named, lambda n: NOT list_contains(r, n)), ',') AS mentioned, CASE WHEN regexp_matches(text, '(?i)\bnot\b') THEN 'PROHIBIT' ELSE 'RECOMMEND' END AS polarity FROM f
""")
def _(t):
    found = annotation.annotate(folded(t), "text", RULES)
    return found.select("doc_id", F.array_join("required", ",").alias("required"), F.array_join("mentioned", ",").alias("mentioned"), "polarity")


@R.query("threshold_quotes", r"""
WITH t AS (SELECT doc_id, regexp_extract(text, '[0-9]{2,}', 0) AS token FROM documents WHERE text IS NOT NULL),
x AS (SELECT d.doc_id, t.token, d.text, (length(d.text) - length(replace(d.text, t.token, ''))) // length(t.token) AS n FROM documents d JOIN t USING (doc_id) WHERE t.token <> ''),
s AS (SELECT *, split_part(text, token, 1) AS b FROM x), q AS (SELECT *, substr(text, length(b) + length(token) + 1) AS a FROM s)
SELECT doc_id, token, CASE WHEN n = 1 THEN md5(trim(list_last(string_split(b, '. ')) || token || split_part(a, '. ', 1) || CASE WHEN contains(a, '. ') THEN '.' ELSE '' END)) END AS quoted, CASE WHEN n <> 1 THEN 'found ' || n || ' times' END AS problem FROM q
""")
def _(t):
    docs = t("documents").select("doc_id", "text").where("text IS NOT NULL")
    tokens = docs.select("doc_id", F.regexp_extract("text", "[0-9]{2,}", 0).alias("token")).where("token <> ''").withColumn("value", F.col("token").cast("double"))
    found = annotation.locate(tokens, docs, "doc_id", "token", "value", "text")
    return found.select("doc_id", "token", F.md5(F.col("quoted").cast("binary")).alias("quoted"), "problem")


@R.query("finding_phrases", """
SELECT o_orderkey, 'Findings: ' || CASE o_orderstatus WHEN 'F' THEN 'order done' WHEN 'O' THEN 'order open' ELSE 'order in part' END || '; ' || CASE WHEN o_totalprice > 100000 THEN 'price high' ELSE 'price low' END || '.' AS line FROM orders
""")
def _(t):
    rows = t("orders").withColumn("size", F.when(F.col("o_totalprice") > 100000, "high").otherwise("low"))
    slots = {"o_orderstatus": {"F": "order done", "O": "order open", "P": "order in part"}, "size": {"high": "price high", "low": "price low"}}
    return rows.select("o_orderkey", annotation.summary(slots, "Findings").alias("line"))


@R.query("mapping_problems", """
WITH m AS (SELECT p_brand AS label, p_type AS target FROM part WHERE p_size < 5), c AS (SELECT label, count(DISTINCT target) AS n FROM m GROUP BY label),
w AS (SELECT DISTINCT p_brand AS label FROM part WHERE p_size > 45 UNION SELECT 'Brand#none')
SELECT coalesce(w.label, c.label) AS label, coalesce(n, 0)::BIGINT AS n_targets, CASE WHEN w.label IS NULL THEN 'unknown' WHEN c.label IS NULL THEN 'missing' ELSE 'several' END AS problem
FROM w FULL JOIN c ON w.label = c.label WHERE w.label IS NULL OR c.label IS NULL OR n > 1
""")
def _(t):
    part = t("part").select(F.col("p_brand").alias("label"), F.col("p_type").alias("target"), "p_size", F.lit("confirmed").alias("status"))
    names = part.where("p_size > 45").select("label").unionByName(part.groupBy().agg(F.lit("Brand#none").alias("label")))
    return annotation.mapping_problems(annotation.confirmed(part.where("p_size < 5")), names, "label", "target")


def _regions(rounds: int) -> str:
    """Three regions of part by size and price, with as many rounds as given written out."""
    d = lambda c: f"(p.x - {c}.x) * (p.x - {c}.x) + (p.y - {c}.y) * (p.y - {c}.y)"
    steps = [
        "p AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, (p_retailprice / 100)::DOUBLE AS y FROM part)",
        f"m AS (SELECT avg(x) AS x, avg(y) AS y FROM p), a AS (SELECT p.x, p.y FROM p, m ORDER BY {d('m')}, k LIMIT 1)",
        f"b AS (SELECT p.x, p.y FROM p, a ORDER BY {d('a')} DESC, k LIMIT 1), c AS (SELECT p.x, p.y FROM p, a, b ORDER BY least({d('a')}, {d('b')}) DESC, k LIMIT 1)",
        "r0 AS (SELECT 0 AS r, x, y FROM a UNION ALL SELECT 1, x, y FROM b UNION ALL SELECT 2, x, y FROM c)",
    ]
    for i in range(rounds):
        steps.append(f"s{i} AS (SELECT k, any_value(p.x) AS x, any_value(p.y) AS y, arg_min(q.r, [{d('q')}, q.r]) AS r FROM p, r{i} q GROUP BY k), r{i + 1} AS (SELECT r, avg(x) AS x, avg(y) AS y FROM s{i} GROUP BY r)")
    return f"WITH {', '.join(steps)}, z AS (SELECT k, arg_min(q.r, [{d('q')}, q.r]) AS r FROM p, r{rounds} q GROUP BY k), n AS (SELECT r, count(*) AS n FROM z GROUP BY r) SELECT row_number() OVER (ORDER BY n DESC, r) AS region, n, round(x, 4) AS c_x, round(y, 4) AS c_y FROM n JOIN r{rounds} USING (r)"


@R.query("value_regions", _regions(6))
def _(t):
    rows = t("part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return stats.regions(rows, "p_partkey", ["x", "y"], 3, rounds=6).select("region", "n", F.round("c_x", 4).alias("c_x"), F.round("c_y", 4).alias("c_y"))


def turns(t):
    rows = t("conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return rows.join(after, ["conv_id", "turn"])


@R.query("turn_differences")
def _(t):
    rows = turns(t).withColumn("d", X.word_difference(F.col("text"), F.col("next")))
    out = annotation.difference_report(rows, "d", "text", "next", RULES)
    return out.select("conv_id", "turn", F.size("d.only_a").alias("n_a"), F.size("d.only_b").alias("n_b"), "touches_clause", "touches_number", F.round(X.similarity(F.col("text"), F.col("next")), 6).alias("alike"))


@R.query("name_similarity", r"""
WITH w AS (SELECT p_partkey AS k, regexp_extract_all(lower(p_name), '[a-z0-9_]+') AS w FROM part),
p AS (SELECT a.k, a.w AS a, b.w AS b FROM w a JOIN w b ON b.k = a.k + 1),
x AS (SELECT k, a, b, coalesce(list_max(list_transform(range(1, len(a) + 1), lambda i: coalesce(list_position(b, a[i]), 0))), 0) > 0 AS one,
  coalesce(list_max(flatten(list_transform(range(1, len(a)), lambda i: list_transform(range(i + 1, len(a) + 1), lambda j: coalesce(list_max(list_transform(range(1, len(b)), lambda m: CASE WHEN b[m] = a[i] AND list_contains(b[m + 1:], a[j]) THEN 2 ELSE 0 END)), 0))))), 0) = 2 AS two FROM p WHERE len(a) <= 2 AND len(b) <= 2)
SELECT k AS p_partkey, round(2.0 * CASE WHEN two THEN 2 WHEN one THEN 1 ELSE 0 END / (len(a) + len(b)), 6)::DOUBLE AS alike FROM x
""")
def _(t):
    part = t("part").select("p_partkey", "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return part.join(after, "p_partkey").select("p_partkey", F.round(X.similarity(F.col("p_name"), F.col("next")), 6).alias("alike"))
