"""Queries over keys, joins, pages and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions.text import content_hash
from veldt.operators import joins, keyed, paging, sets
from veldt.plans.registry import Registry

R = Registry()


def us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


@R.query("latest_per_key", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def _(t):
    return keyed.latest_per_key(t("events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).drop("ts")


@R.query("first_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1
""")
def _(t):
    return keyed.first_per_key(t("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@R.query("as_of_latest", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') WHERE rn = 1
""")
def _(t):
    rows = t("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return keyed.as_of(rows, "o_custkey", "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@R.query("history_before", """
SELECT o_orderkey, count(*) OVER w AS n_before, max(o_totalprice) OVER w AS max_before, round(sum(o_totalprice) OVER w, 2) AS sum_before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1970-01-01', o_orderdate::DATE) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def _(t):
    found = keyed.history_before(t("orders"), "o_custkey", "o_orderdate", {"n_before": ("count", F.lit(1)), "max_before": ("max", F.col("o_totalprice")), "sum_before": ("sum", F.col("o_totalprice"))})
    return found.select("o_orderkey", "n_before", "max_before", F.round("sum_before", 2).alias("sum_before"))


@R.query("baseline_change", """
WITH e AS (SELECT o_custkey, count(*) AS n, arg_min(o_orderdate, (o_orderdate, o_orderkey)) AS at0, arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS at1,
  arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS v0, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v1 FROM orders GROUP BY o_custkey),
r AS (SELECT *, CASE WHEN n < 2 THEN 'no earlier measurement' WHEN at0 >= at1 THEN 'baseline not before current' WHEN v0 <= 0 THEN 'baseline is not positive' END AS reason FROM e),
c AS (SELECT *, CASE WHEN reason IS NULL THEN (v0 - v1) / v0 * 100 END AS p, CASE WHEN reason IS NULL THEN date_diff('day', at0, at1) / 7.0 END AS w FROM r)
SELECT o_custkey, round(p, 4) AS change_percent, round(w, 4)::DOUBLE AS weeks, coalesce(w >= 4 AND p < 50, false) AS stalled, reason FROM c
""")
def _(t):
    found = keyed.baseline_change(t("orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return found.withColumns({"change_percent": F.round("change_percent", 4), "weeks": F.round("weeks", 4)})


@R.query("lateral_top1", """
SELECT c_custkey, o.o_orderkey AS last_order, o.o_totalprice AS last_price FROM customer LEFT JOIN LATERAL (
  SELECT * FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true
""")
def _(t):
    top = keyed.lateral_top1(t("customer"), t("orders"), "c_custkey", "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    return top.select("c_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_price"))


@R.query("per_group_limit", """
SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5
""")
def _(t):
    return keyed.per_group_limit(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).drop("o_totalprice").withColumn("rank", F.col("rank").cast("long"))


@R.query("supersede_latest", """
SELECT o_orderkey, o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey) AS is_current FROM orders
""")
def _(t):
    return keyed.superseded(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate").select("o_orderkey", "is_current")


@R.query("anti_join_once", """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
""")
def _(t):
    return joins.not_yet(t("customer").select("c_custkey"), t("orders").where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey")


@R.query("semi_join_in_or", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR o_totalprice > 400000
""")
def _(t):
    marked = joins.membership(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", {"building": t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")})
    return marked.where("building OR o_totalprice > 400000").select("o_orderkey")


@R.query("audit_missing_sides", """
SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_return, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') AS has_final
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')
""")
def _(t):
    lines = t("lineitem")
    sides = {"has_return": lines.where("l_returnflag = 'R'").select("l_orderkey"), "has_final": lines.where("l_linestatus = 'F'").select("l_orderkey")}
    return joins.membership(t("orders").select("o_orderkey"), "o_orderkey", sides).where("NOT has_return OR NOT has_final")


@R.query("role_playing_dimension", """
SELECT sn.n_name AS supplier_nation, cn.n_name AS customer_nation, count(*) AS n FROM lineitem
JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey GROUP BY 1, 2
""")
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_suppkey")
    # counted by the two keys first; names join the few rows that are left
    pairs = (
        lines.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("s_nationkey", "c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    nation = t("nation")
    sn = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    cn = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    return pairs.join(sn, "s_nationkey").join(cn, "c_nationkey").select("supplier_nation", "customer_nation", "n")


@R.query("left_join_on_constant", """
SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderstatus = 'F' GROUP BY o_orderkey
""")
def _(t):
    orders, lines = t("orders").select("o_orderkey", "o_orderstatus"), t("lineitem").select("l_orderkey")
    return orders.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("o_orderstatus") == "F"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_lines"))


@R.query("scalar_subqueries", """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS max_price FROM customer
""")
def _(t):
    per = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("max_price"))
    return t("customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "max_price")


@R.query("exists_nonequi", """
SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM customer x JOIN orders ON o_custkey = x.c_custkey
  WHERE x.c_nationkey = c.c_nationkey AND o_orderpriority = '5-LOW' AND o_totalprice > c.c_acctbal * 55)
""")
def _(t):
    customers = t("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    low = t("orders").where("o_orderpriority = '5-LOW'").select("o_custkey", "o_totalprice")
    placed = customers.join(low, F.col("c_custkey") == F.col("o_custkey"))
    top = joins.greatest_before(placed, "c_nationkey", F.lit(True), "o_totalprice", "most")
    return customers.join(top, "c_nationkey").where(F.col("most") > F.col("c_acctbal") * 55).select("c_custkey")


@R.query("stale_reference", """
WITH s AS (SELECT doc_id, sha256(lower(text)) AS h FROM documents UNION ALL SELECT max(doc_id) + 1, 'gone' FROM documents)
SELECT s.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS state FROM s LEFT JOIN documents d ON d.doc_id = s.doc_id WHERE d.doc_id IS NULL OR s.h <> sha256(d.text)
""")
def _(t):
    docs = t("documents").select("doc_id", "text")
    gone = docs.agg((F.max("doc_id") + 1).alias("doc_id")).withColumn("h", F.lit("gone"))
    snapshot = docs.select("doc_id", F.sha2(F.lower("text"), 256).alias("h")).unionByName(gone)
    return joins.stale_references(docs.select("doc_id", F.sha2("text", 256).alias("h")), snapshot, "doc_id", "h")


@R.query("mutual_best", """
WITH n AS (SELECT s_nationkey AS a, c_nationkey AS b, round(sum(l_quantity), 2) AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY s DESC, a) AS rb FROM n)
SELECT a, b, s FROM r WHERE ra = 1 AND rb = 1
""")
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    pairs = (
        lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))
        .agg(F.round(F.sum("l_quantity"), 2).alias("s"))
    )
    return joins.mutual_best(pairs, "a", "b", "s")


@R.query("strict_lookup", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    return joins.strict_lookup(t("orders").select("o_orderkey", "o_custkey"), t("customer"), "o_custkey", "c_custkey", ["c_mktsegment"]).drop("o_custkey")


@R.query("known_ids_union", "SELECT event_id AS id FROM events UNION SELECT o_orderkey FROM orders")
def _(t):
    return sets.known_ids(t("events").select("event_id"), t("orders").select("o_orderkey"))


@R.query("set_difference_counts", """
SELECT count(*) FILTER (WHERE r IS NULL) AS only_left, count(*) FILTER (WHERE l IS NULL) AS only_right, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS both
FROM (SELECT DISTINCT p_partkey AS l FROM part) a FULL JOIN (SELECT DISTINCT l_partkey AS r FROM lineitem) b ON a.l = b.r
""")
def _(t):
    return sets.difference_counts(t("part").select("p_partkey"), t("lineitem").select("l_partkey"))


@R.query("multiset_difference", """
SELECT nation, sum(n)::BIGINT AS surplus FROM (SELECT c_nationkey AS nation, 1 AS n FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY nation HAVING sum(n) <> 0
""")
def _(t):
    return sets.multiset_difference(t("customer").select(F.col("c_nationkey").alias("nation")), t("supplier").select(F.col("s_nationkey").alias("nation")))


@R.query("union_live_archive", """
SELECT status, count(*) AS n, sum(part)::BIGINT AS from_archive FROM (SELECT o_orderstatus AS status, 0 AS part FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
  UNION ALL SELECT o_orderstatus, 1 FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') GROUP BY status
""")
def _(t):
    orders = t("orders").select(F.col("o_orderstatus").alias("status"), "o_orderdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    both = sets.ordered_concat(["o_orderdate"], orders.where(F.col("o_orderdate") >= cut), orders.where(F.col("o_orderdate") < cut))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("from_archive"))


@R.query("keyset_page", """
SELECT o_orderkey, o_totalprice, (SELECT count(*) > 500 FROM (SELECT 1 FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 501)) AS has_more,
  max(o_orderkey) OVER () AS next_cursor FROM (SELECT * FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500)
""")
def _(t):
    return paging.keyset_page(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 500)


@R.query("resend_window", """
SELECT event_id, user_id FROM events WHERE event_id <= 900 AND ts >= TIMESTAMP '2024-01-01 12:00:00' ORDER BY event_id DESC LIMIT 200
""")
def _(t):
    return paging.resend_window(t("events").select("event_id", "user_id", "ts"), "event_id", 900, "ts", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), 200).select("event_id", "user_id")


@R.query("offset_page", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey DESC LIMIT 10 OFFSET 30")
def _(t):
    return paging.offset_page(t("orders").select("o_orderkey", "o_orderpriority"), [F.col("o_orderpriority"), F.col("o_orderkey").desc()], 3, 10)


@R.query("nulls_last_sort", """
SELECT c_custkey, last_price FROM (SELECT c_custkey, max(o_totalprice) AS last_price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey)
ORDER BY last_price IS NOT NULL, last_price DESC NULLS LAST, c_custkey LIMIT 50
""")
def _(t):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("last_price"))
    rows = t("customer").select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.orderBy(F.col("last_price").isNotNull(), F.col("last_price").desc_nulls_last(), "c_custkey").limit(50).select("c_custkey", "last_price")


@R.query("budget_batch", """
SELECT doc_id, running FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, (sum(n_chars) OVER (ORDER BY doc_id))::BIGINT AS running FROM documents)
WHERE rn <= 50 AND (rn = 1 OR running <= 262144)
""")
def _(t):
    return paging.budget_batch(t("documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 50, 262144).select("doc_id", "running")


@R.query("outbox_claim", "SELECT event_id FROM events WHERE event_type <> 'purchase' ORDER BY event_id LIMIT 100")
def _(t):
    rows = t("events").withColumn("published", F.when(F.col("event_type") == "purchase", F.col("ts")))
    return paging.claim(rows, "published", "event_id", 100).select("event_id")


@R.query("first_occurrence_order", """
SELECT event_type, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY event_type
""")
def _(t):
    return t("events").groupBy("event_type").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@R.query("content_hash", "SELECT doc_id, sha256(concat_ws('|', doc_id::VARCHAR, coalesce(lang, ''), coalesce(text, ''))) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", content_hash(F.col("doc_id"), F.col("lang"), F.col("text")).alias("h"))


@R.query("left_merge_chain", """
SELECT d.doc_id, l.quality, e.label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id
""")
def _(t):
    docs = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.join(t("embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")


@R.query("full_outer_sides", """
SELECT coalesce(d.doc_id, e.vec_id) AS id, d.doc_id IS NOT NULL AS has_text, e.vec_id IS NOT NULL AS has_vector FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id
""")
def _(t):
    d, e = t("documents").select(F.col("doc_id").alias("id"), F.lit(True).alias("a")), t("embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("b"))
    return d.join(e, "id", "full_outer").select("id", F.coalesce("a", F.lit(False)).alias("has_text"), F.coalesce("b", F.lit(False)).alias("has_vector"))


@R.query("null_safe_filters", """
SELECT event_type, count(*) FILTER (WHERE k IS DISTINCT FROM '9') AS n_other, count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10') AS n_between,
  count(*) FILTER (WHERE event_type ILIKE '%UP') AS n_like FROM (SELECT *, CASE WHEN value > 1 THEN json_extract_string(props, '$.k') END AS k FROM events) GROUP BY event_type
""")
def _(t):
    k = F.when(F.col("value") > 1, F.get_json_object("props", "$.k"))
    between = F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-10").cast("timestamp_ntz"))
    return t("events").groupBy("event_type").agg(
        F.count_if(~k.eqNullSafe("9")).alias("n_other"), F.count_if(between).alias("n_between"), F.count_if(F.col("event_type").ilike("%UP")).alias("n_like")
    )
