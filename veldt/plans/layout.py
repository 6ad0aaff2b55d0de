"""Queries of tables given by cell rectangles and of outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import boxes, grids, outline
from veldt.plans.registry import Registry

R = Registry()


@R.query("table_grid", """
SELECT o_custkey AS table_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS row, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 3 END AS n_cells,
  CASE WHEN o_orderstatus = 'P' THEN 'Order / key / Order / status: P' || o_orderkey ELSE 'Order / key: ' || o_orderkey || ' | Order / status: ' || o_orderstatus END || ' | price: ' || floor(o_totalprice)::BIGINT AS text
FROM orders
""")
def _(t):
    """A customer's orders as a table: two header rows, the price over both, and one cell over two columns where an order is pending."""
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    box = lambda left, top, right, bottom, text: F.struct(*[F.lit(x).cast("double").alias(k) if not hasattr(x, "cast") else x.cast("double").alias(k) for k, x in zip("ltrb", (left, top, right, bottom))], text.cast("string").alias("text"))
    heads = F.array(box(10, -20, 110, -10, F.lit("Order")), box(10, -10, 60, 0, F.lit("key")), box(60, -10, 110, 0, F.lit("status")), box(110, -20, 160, 0, F.lit("price")))
    top, key, status = F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_orderstatus")
    price = box(110, top, 160, top + 0.5, F.floor("o_totalprice"))
    wide = F.array(box(10, top, 110, top + 0.5, F.concat(F.lit("P"), key.cast("string"))), price)
    plain = F.array(box(10, top, 60, top + 0.5, key), box(60, top, 110, top + 0.5, status), price)
    body = orders.select("o_custkey", F.explode(F.when(status == "P", wide).otherwise(plain)).alias("c"))
    cells = body.unionByName(orders.select("o_custkey").distinct().select("o_custkey", F.explode(heads).alias("c"))).select("o_custkey", "c.*")
    rows, _problems = grids.grid(cells, "o_custkey", ("l", "t", "r", "b"), "text", 2)
    return rows.withColumnRenamed("table", "table_id")


LEVEL = "CASE WHEN length(line) BETWEEN 1 AND 200 THEN 1 + length(line) % 3 ELSE 0 END"


@R.query("outline_paths", f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM s), l AS (SELECT *, {LEVEL} AS level FROM u),
h AS (SELECT *, last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN level = 2 THEN pos END IGNORE NULLS) OVER w AS p2, last_value(CASE WHEN level = 3 THEN pos END IGNORE NULLS) OVER w AS p3,
  last_value(CASE WHEN level = 1 THEN line END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 2 THEN line END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN level = 3 THEN line END IGNORE NULLS) OVER w AS t3,
  first_value(CASE WHEN level BETWEEN 1 AND 1 THEN pos END IGNORE NULLS) OVER n AS n1, first_value(CASE WHEN level BETWEEN 1 AND 2 THEN pos END IGNORE NULLS) OVER n AS n2, first_value(CASE WHEN level BETWEEN 1 AND 3 THEN pos END IGNORE NULLS) OVER n AS n3,
  max(pos) OVER (PARTITION BY doc_id) AS last
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc_id, pos, level, md5(array_to_string(list_filter([t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END], lambda x: x IS NOT NULL), ' > ')) AS path,
  CASE level WHEN 1 THEN coalesce(n1 - 1, last) WHEN 2 THEN coalesce(n2 - 1, last) WHEN 3 THEN coalesce(n3 - 1, last) END AS section_end FROM h
""")
def _(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    rows = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), "line", F.expr(LEVEL).alias("level"))
    found = outline.paths(rows, "doc_id", "pos", "level", "line", 3)
    return found.select("doc_id", "pos", "level", F.md5(F.array_join("path", " > ").cast("binary")).alias("path"), "section_end")


@R.query("heading_order", """
WITH c AS (SELECT unnest(['signup', 'view', 'click', 'purchase', 'error']) AS title, unnest(range(1, 6)) AS place),
f AS (SELECT user_id, event_type AS title, min(event_id) AS pos FROM events GROUP BY ALL), i AS (SELECT user_id, title, place, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS idx FROM f JOIN c USING (title)),
n AS (SELECT user_id, count(*) AS n FROM i GROUP BY user_id), bad AS (SELECT a.user_id, (1 << (4 - a.idx)) + (1 << (4 - b.idx)) AS pair FROM i a JOIN i b ON a.user_id = b.user_id AND a.idx < b.idx AND a.place > b.place),
ok AS (SELECT user_id, mask FROM n, (SELECT range AS mask FROM range(32)) WHERE mask % (1 << (5 - n)) = 0 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.user_id = n.user_id AND mask & pair = pair)),
best AS (SELECT user_id, arg_max(mask, (bit_count(mask), mask)) AS mask FROM ok GROUP BY user_id)
SELECT u.user_id, c.title, c.place, CASE WHEN idx IS NULL THEN 'missing' WHEN mask & (1 << (4 - idx)) > 0 THEN 'in_order' ELSE 'out_of_order' END AS status
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN c LEFT JOIN i ON i.user_id = u.user_id AND i.title = c.title LEFT JOIN best ON best.user_id = u.user_id
""")
def _(t):
    events = t("events").select("user_id", "event_id", F.col("event_type").alias("title"))
    confirmed = events.sparkSession.createDataFrame([(name, k + 1) for k, name in enumerate(("signup", "view", "click", "purchase", "error"))], "title string, place long")
    return outline.against(events, confirmed, "user_id", "event_id", "title", "place")


BOX = """SELECT l_suppkey * 10 + l_linenumber AS grp, l_orderkey * 10 + l_linenumber AS id, l_quantity AS l, l_discount * 400 AS t, l_quantity + 10 + l_tax * 100 AS r, l_discount * 400 + 10 + l_linenumber AS b, l_extendedprice AS score"""


@R.query("box_suppression", f"""
WITH RECURSIVE x AS ({BOX} FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS k FROM x),
f AS (
  SELECT DISTINCT grp, 0::BIGINT AS k, NULL::BIGINT AS id, [] ::STRUCT(l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE)[] AS kept FROM x
  UNION ALL
  SELECT grp, k, CASE WHEN stays THEN id END, CASE WHEN stays THEN list_append(kept, me) ELSE kept END FROM (
    SELECT o.grp, o.k, o.id, f.kept, {{'l': o.l::DOUBLE, 't': o.t::DOUBLE, 'r': o.r::DOUBLE, 'b': o.b::DOUBLE}} AS me,
      NOT coalesce(list_bool_or(list_transform(f.kept, lambda p: greatest(least(p.r, o.r) - greatest(p.l, o.l), 0) * greatest(least(p.b, o.b) - greatest(p.t, o.t), 0)
        > 0.5 * ((p.r - p.l) * (p.b - p.t) + (o.r - o.l) * (o.b - o.t) - greatest(least(p.r, o.r) - greatest(p.l, o.l), 0) * greatest(least(p.b, o.b) - greatest(p.t, o.t), 0)))), false) AS stays
    FROM f JOIN o ON o.grp = f.grp AND o.k = f.k + 1)
)
SELECT grp, id FROM f WHERE id IS NOT NULL
""")
def _(t):
    lines = t("lineitem").selectExpr(*[f"{x} AS {n}" for x, n in (("l_suppkey * 10 + l_linenumber", "grp"), ("l_orderkey * 10 + l_linenumber", "id"), ("l_quantity", "l"), ("l_discount * 400", "t"), ("l_quantity + 10 + l_tax * 100", "r"), ("l_discount * 400 + 10 + l_linenumber", "b"), ("l_extendedprice", "score"))])
    return boxes.suppress_boxes(lines, "grp", ("l", "t", "r", "b"), "score", "id").select("grp", "id")
