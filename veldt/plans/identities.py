"""Queries over sessions, decisions, overlaps and structured texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import text as X
from veldt.operators import keyed, sessions
from veldt.plans.registry import Registry

R = Registry()


@R.query("update_from_join", """
SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN o.top ELSE c_acctbal END AS c_acctbal, o.k IS NOT NULL AS updated FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' GROUP BY 1) o ON o.k = c_custkey
""")
def _(t):
    top = t("orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return sessions.update_from(t("customer").select("c_custkey", "c_acctbal"), top, "c_custkey", {"c_acctbal": "top"})


@R.query("active_sessions", """
SELECT event_id FROM events WHERE event_type <> 'error' AND ts + INTERVAL 2 HOUR > TIMESTAMP '2024-01-20' AND value < 100
""")
def _(t):
    rows = t("events").select("event_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("expires"), F.when(F.col("value") >= 100, F.col("ts")).alias("device_revoked"))
    return rows.where(sessions.active(F.col("revoked"), F.col("expires"), F.lit("2024-01-20").cast("timestamp_ntz"), F.col("device_revoked"))).select("event_id")


@R.query("grace_window", """
WITH s AS (SELECT event_id, lead(event_id) OVER w AS nxt, epoch_us(lead(ts) OVER w) AS at, value > 10 AS used FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT a.event_id, a.nxt IS NULL OR (coalesce(NOT b.used, false) AND a.at + 864000000000 >= epoch_us(TIMESTAMP '2024-01-25')) AS usable FROM s a LEFT JOIN s b ON b.event_id = a.nxt
""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t("events").select("event_id", F.lead("event_id").over(w).alias("nxt"), F.unix_micros(F.lead("ts").over(w).cast("timestamp")).alias("at"), "value")
    now = F.unix_micros(F.lit("2024-01-25").cast("timestamp"))
    return sessions.in_grace(rows, "event_id", "nxt", "at", F.col("value") > 10, now, 864000).select("event_id", "usable")


def _rounds(most: int) -> str:
    """Rounds of mutual best pairs written out; each takes one pair at least, so as many as there are names are enough."""
    steps = ["""p0 AS MATERIALIZED (SELECT s_nationkey AS a, c_nationkey AS b, round(sum(l_quantity), 2) AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING round(sum(l_quantity), 2) >= 1)"""]
    for i in range(most):
        best = f"SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY s DESC, a) AS rb FROM p{i}"
        steps.append(f"m{i} AS MATERIALIZED (SELECT a, b, s, {i + 1} AS round FROM ({best}) WHERE ra = 1 AND rb = 1)")
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT * FROM p{i} WHERE a NOT IN (SELECT a FROM m{i}) AND b NOT IN (SELECT b FROM m{i}))")
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(f'SELECT * FROM m{i}' for i in range(most))}"


@R.query("match_in_rounds", _rounds(25))
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    pairs = (
        lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))
        .agg(F.round(F.sum("l_quantity"), 2).alias("s"))
    )
    return sessions.match_rounds(pairs, "a", "b", "s", 1.0)


@R.query("overlap_scores", """
WITH p AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE value > 20) AS a, list(DISTINCT event_type) FILTER (WHERE value < 5) AS b FROM events GROUP BY user_id),
c AS (SELECT user_id, coalesce(len(a), 0) AS na, coalesce(len(b), 0) AS nb, coalesce(len(list_intersect(a, b)), 0) AS n FROM p)
SELECT user_id, CASE WHEN na + nb = 0 THEN 1.0 ELSE round(2 * n / (na + nb), 6) END::DOUBLE AS dice, CASE WHEN na + nb = 0 THEN 1.0 ELSE round(n / (na + nb - n), 6) END::DOUBLE AS iou FROM c
""")
def _(t):
    kinds = lambda cond: F.collect_set(F.when(cond, F.col("event_type")))
    sets = t("events").groupBy("user_id").agg(kinds(F.col("value") > 20).alias("a"), kinds(F.col("value") < 5).alias("b"))
    dice, iou = sessions.overlap(F.col("a"), F.col("b"))
    return sets.select("user_id", F.round(dice, 6).alias("dice"), F.round(iou, 6).alias("iou"))


@R.query("policy_evaluation", """
WITH s AS (SELECT l.doc_id, toxic = 1 AS y, d.lang, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
p AS (SELECT lang, y, 'long' AS policy, n_chars > 2000 AS d FROM s UNION ALL SELECT lang, y, 'careful', CASE WHEN n_chars > 4000 THEN true WHEN n_chars < 500 THEN false END FROM s)
SELECT lang, policy, round(count(d) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE d = y) / nullif(count(d), 0), 6) AS accuracy, round(count(*) FILTER (WHERE d AND y) / nullif(count(*) FILTER (WHERE d IS NOT NULL AND y), 0), 6) AS recall FROM p GROUP BY 1, 2
""")
def _(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    n = F.col("n_chars")
    found = sessions.policies(rows, F.col("toxic"), {"long": n > 2000, "careful": F.when(n > 4000, True).when(n < 500, False)}, ["lang"])
    return found.withColumns({c: F.round(c, 6) for c in ("coverage", "accuracy", "recall")})


@R.query("control_pairs", """
WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT least(doc_id, doc_id + 1) AS a, greatest(doc_id, doc_id + 1) AS b FROM labels),
p AS (SELECT doc_id AS b, ('0x' || substr(md5('3:' || doc_id), 1, 13))::BIGINT % n AS spot FROM documents, n),
q AS (SELECT doc_id AS a, i, ('0x' || substr(md5('3:' || doc_id || ':' || i), 1, 13))::BIGINT % n AS spot FROM documents, n, range(1, 3) r(i)),
d AS (SELECT a, i, min(b) AS b FROM q JOIN p USING (spot) GROUP BY a, i)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM d WHERE a <> b AND NOT EXISTS (SELECT 1 FROM k WHERE k.a = least(d.a, d.b) AND k.b = greatest(d.a, d.b))
""")
def _(t):
    known = t("labels").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return sessions.control_pairs(t("documents").select("doc_id"), "doc_id", known, "a", "b", 2, 3)


@R.query("greatest_of_nullable_times", """
SELECT user_id, greatest(coalesce(max(event_id) FILTER (WHERE event_type = 'click' AND value > 60), 0), coalesce(max(event_id) FILTER (WHERE event_type = 'view' AND value > 60), 0)) AS last FROM events GROUP BY user_id
""")
def _(t):
    last = lambda s: F.coalesce(F.max(F.when((F.col("event_type") == s) & (F.col("value") > 60), F.col("event_id"))), F.lit(0))
    return t("events").groupBy("user_id").agg(F.greatest(last("click"), last("view")).alias("last"))


#: Comma and blank become a hyphen and a line's end here, so that both rules of the join meet real words.
BROKEN = "array_to_string(list_filter(string_split(replace(text, ', ', '-' || chr(10)), chr(10)), lambda x: x <> ''), chr(10))"
HYPHEN = "regexp_replace({}, '(\\p{{Ll}})-\\n(\\p{{Ll}})', '\\1\\2', 'g')"


@R.query("line_join", f"SELECT doc_id, sha256(replace({HYPHEN.format(HYPHEN.format(BROKEN))}, chr(10), ' ')) AS h FROM documents")
def _(t):
    lines = F.filter(F.split(F.replace("text", F.lit(", "), F.lit("-\n")), "\n"), lambda x: x != "")
    return t("documents").select("doc_id", F.sha2(X.joined_lines(lines), 256).alias("h"))


@R.query("table_rows_as_text", """
SELECT p_partkey, concat_ws(' | ', CASE WHEN p_size > 10 THEN 'name: ' || p_name END, 'brand: ' || p_brand, 'type: ' || p_type) AS line FROM part
""")
def _(t):
    cells = F.array(F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(F.lit(" ")), F.col("p_brand"), F.col("p_type"))
    return t("part").select("p_partkey", X.labelled_row(F.array(F.lit("name"), F.lit("brand"), F.lit("type")), cells).alias("line"))


@R.query("cross_references", """
SELECT event_id, (value::INT % 7)::BIGINT AS figure FROM events
""")
def _(t):
    n = F.bround("value").cast("int") % 7
    said = F.concat(F.lit("see Figure "), n.cast("string"), F.lit(" and figure "), n.cast("string"), F.lit("; figures differ"))
    return t("events").select("event_id", F.explode(X.references(said, "figure")).alias("figure")).withColumn("figure", F.col("figure").cast("long"))


@R.query("answer_reader", """
SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'headings out of order' WHEN 'error' THEN 'unexpected line: Other' WHEN 'signup' THEN 'heading missing' ELSE 'heading twice' END AS problem FROM events
""")
def _(t):
    kind = F.col("event_type")
    answer = (
        F.when(kind == "view", "Summary\n- a\nNext\n- b").when(kind == "click", "Next\n- a\nSummary\n- b").when(kind == "error", "Summary\nOther\n- b").when(kind == "signup", "Summary\n- a").otherwise("Summary\nSummary\nNext")
    )
    return t("events").select("event_id", X.answer_problem(answer, ["Summary", "Next"]).alias("problem"))


@R.query("word_difference", r"""
WITH w AS (SELECT p_partkey AS k, regexp_extract_all(lower(p_name), '[a-z0-9_]+') AS w FROM part),
x AS (SELECT a.k, a.w[1] AS p, a.w[2] AS q, b.w[1] AS r, b.w[2] AS s FROM w a JOIN w b ON b.k = a.k + 1 WHERE len(a.w) = 2 AND len(b.w) = 2),
c AS (SELECT *, CASE WHEN p = r AND q = s THEN 'same' WHEN p = r THEN 'first' WHEN q = r THEN 'left' WHEN q = s THEN 'last' WHEN p = s THEN 'right' ELSE 'none' END AS c FROM x)
SELECT k AS p_partkey, CASE c WHEN 'same' THEN '' WHEN 'first' THEN q WHEN 'left' THEN p WHEN 'last' THEN p WHEN 'right' THEN q ELSE p || ' ' || q END AS only_a,
  CASE c WHEN 'same' THEN '' WHEN 'first' THEN s WHEN 'left' THEN s WHEN 'last' THEN r WHEN 'right' THEN r ELSE r || ' ' || s END AS only_b FROM c
""")
def _(t):
    part = t("part").select("p_partkey", "p_name")
    rows = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next")), "p_partkey")
    rows = rows.select("p_partkey", X.word_difference(F.col("p_name"), F.col("next")).alias("d"))
    return rows.select("p_partkey", F.array_join("d.only_a", " ").alias("only_a"), F.array_join("d.only_b", " ").alias("only_b"))


@R.query("plan_by_priority", """
SELECT o_custkey, o_orderpriority, count(*) AS n_best FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders) WHERE r = 1 GROUP BY 1, 2
""")
def _(t):
    # the best priority of each case; more than one row of it is an ambiguity that the count tells
    counts = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_best"))
    return keyed.first_per_key(counts, "o_custkey", ["o_orderpriority"])


@R.query("mode_flags", "SELECT user_id, bool_and(value > 1) AS all_large, bool_or(event_type = 'error') AS any_error FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.bool_and(F.col("value") > 1).alias("all_large"), F.bool_or(F.col("event_type") == "error").alias("any_error"))
