"""Queries that write and read again: sinks, versions, batches, streams; and the small operators beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veldt.functions import text as X
from veldt.operators import events as E
from veldt.operators import quality, sets
from veldt.operators.shared import scratch
from veldt.plans.registry import Registry
from veldt.sources import sinks, tables
from veldt.streaming import events as S

R = Registry()


def folder(spark, name):
    return f"{scratch(spark)}/veldt-{name}-{uuid.uuid4().hex}"


@R.query("appended_rows", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def _(t):
    events, path = t("events"), folder(t("events").sparkSession, "append")
    low = F.coalesce(F.col("value") < 50, F.lit(False))
    sinks.append(events.where(low), path)
    sinks.append(events.where(~low), path)
    return events.sparkSession.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@R.query("evolving_rows", "SELECT count(*) AS n, count(event_type) FILTER (WHERE value >= 50) AS n_typed, max(event_id) AS last FROM events")
def _(t):
    events, path = t("events"), folder(t("events").sparkSession, "evolving")
    low = F.coalesce(F.col("value") < 50, F.lit(False))
    sinks.append_evolving(events.sparkSession, events.where(low).select("event_id", "value"), path)
    sinks.append_evolving(events.sparkSession, events.where(~low).select("event_id", "value", "event_type"), path)
    return sinks.read_evolving(events.sparkSession, path).agg(F.count(F.lit(1)).alias("n"), F.count("event_type").alias("n_typed"), F.max("event_id").alias("last"))


@R.query("versioned_load", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS kept_on_failure, true AS frozen FROM orders")
def _(t):
    orders, home = t("orders"), folder(t("orders").sparkSession, "versions")
    spark = orders.sparkSession
    sinks.load_version(orders.limit(0), home, "r1", {})
    target = sinks.load_version(orders, home, "r1", {"has rows": lambda d: not d.isEmpty()}, replace=True)

    def refused(df, checks):
        try:
            sinks.load_version(df, home, "r1", checks, replace=True)
        except ValueError:
            return True
        return False

    kept = refused(orders.limit(0), {"has rows": lambda d: not d.isEmpty()})
    sinks.freeze(spark, home, "r1")
    frozen = refused(orders, {})
    found = spark.read.schema(orders.schema).parquet(target)
    return found.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select("n", "total", F.lit(kept).alias("kept_on_failure"), F.lit(frozen).alias("frozen"))


@R.query("batch_outputs", """
SELECT 'claims' AS output, count(*) AS n, count(DISTINCT user_id) AS n_keys FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT 'audit', count(*), count(DISTINCT user_id) FROM events WHERE event_type IN ('click', 'view') AND value > 10
""")
def _(t):
    events = t("events").select("user_id", "event_type", "value")
    spark, home = events.sparkSession, folder(t("events").sparkSession, "batches")
    for number, kind in enumerate(("click", "view")):
        batch = events.where(F.col("event_type") == kind)
        for _attempt in range(2):  # a batch that runs again replaces its own files
            sinks.write_batch(batch, number, {"claims": batch, "audit": batch.where("value > 10")}, home)
    read = lambda name: spark.read.schema(events.schema).parquet(f"{home}/{name}/batch=0", f"{home}/{name}/batch=1").agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_keys"))
    return read("claims").unionByName(read("audit"))


@R.query("jsonl_latest", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(t):
    events, path = t("events").select("user_id", "event_id", "value"), folder(t("events").sparkSession, "lines")
    events.write.json(path)
    return tables.read_jsonl_latest(events.sparkSession, path, "user_id long, event_id long, value double", "user_id", "event_id").select("user_id", "event_id", "value")


@R.query("parameter_join", "SELECT w.kind, count(event_id) AS n, count(event_id) * w.weight AS points FROM (VALUES ('click', 2), ('error', 5), ('none', 7)) w(kind, weight) LEFT JOIN events ON event_type = kind GROUP BY w.kind, w.weight")
def _(t):
    asked = tables.parameter_rows(t("events").sparkSession, {"kind": ["click", "error", "none"], "weight": [2, 5, 7]}, "kind string, weight long")
    counts = asked.join(t("events"), F.col("event_type") == F.col("kind"), "left").groupBy("kind", "weight").agg(F.count("event_id").alias("n"))
    return counts.select("kind", "n", (F.col("n") * F.col("weight")).alias("points"))


@R.query("parts_in_order", """
SELECT part, event_id, row_number() OVER (ORDER BY part, event_id) AS place FROM (SELECT 0 AS part, event_id FROM events WHERE event_type = 'error' AND value > 90 UNION ALL SELECT 1, event_id FROM events WHERE event_type = 'signup' AND value > 90)
""")
def _(t):
    some = lambda kind: t("events").where((F.col("event_type") == kind) & (F.col("value") > 90)).select("event_id")
    parts = sets.ordered_concat(["event_id"], some("error"), some("signup"))
    counted = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = {r["part"]: r["size"] for r in counted.collect()}  # one row a part
    from pyspark.sql import Window

    own = F.row_number().over(Window.partitionBy("part").orderBy("event_id"))
    shift = F.when(F.col("part") == 1, F.lit(before.get(0, 0))).otherwise(F.lit(0))
    return parts.select("part", "event_id", (own + shift).cast("long").alias("place"))


@R.query("sequence_equality", """
WITH s AS (SELECT user_id, list(event_type ORDER BY event_id) FILTER (WHERE value > 40) AS a, list(event_type ORDER BY value, event_id) FILTER (WHERE value > 40) AS b FROM events GROUP BY user_id)
SELECT user_id, coalesce(a, []) = coalesce(b, []) AS same_order, list_sort(coalesce(a, [])) = list_sort(coalesce(b, [])) AS same_members FROM s
""")
def _(t):
    kept = F.when(F.col("value") > 40, F.struct("event_id", "event_type"))
    by_value = F.when(F.col("value") > 40, F.struct("value", "event_id", "event_type"))
    rows = t("events").groupBy("user_id").agg(F.sort_array(F.collect_list(kept))["event_type"].alias("a"), F.sort_array(F.collect_list(by_value))["event_type"].alias("b"))
    return rows.select("user_id", (F.col("a") == F.col("b")).alias("same_order"), (F.array_sort("a") == F.array_sort("b")).alias("same_members"))


@R.query("context_headers", "SELECT doc_id, sha256(coalesce(nullif(source, '') || chr(10), '') || text) AS headed, sha256(text) AS body FROM documents")
def _(t):
    headed = X.with_header(F.col("source"), F.col("text"))
    return t("documents").select("doc_id", F.sha2(headed, 256).alias("headed"), F.sha2(X.without_header(headed, F.coalesce("source", F.lit(""))), 256).alias("body"))


@R.query("sub_items", r"""
WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: true) AS l FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, list_transform(l, lambda x, i: {'mark': i > 1 AND regexp_matches(x, '^[A-Z][a-z]+ '), 'x': x}) AS l FROM p)
SELECT doc_id, len(list_filter(l, lambda s: s.mark))::BIGINT AS n_labelled, md5(array_to_string(list_transform(list_filter(l, lambda s: s.mark), lambda s: regexp_extract(s.x, '^([A-Z][a-z]+) ', 1)), ',')) AS labels FROM m
""")
def _(t):
    items = X.sub_items(F.col("text"), r"\n([A-Z][a-z]+) ")
    found = t("documents").where("text IS NOT NULL").select("doc_id", F.filter(items, lambda x: x["label"].isNotNull()).alias("i"))
    return found.select("doc_id", F.size("i").cast("long").alias("n_labelled"), F.md5(F.array_join("i.label", ",").cast("binary")).alias("labels"))


@R.query("workflow_outcomes", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'duplicate' WHEN o_totalprice < 20000 THEN 'superseded' WHEN o_orderpriority LIKE '5%' THEN 'retry' ELSE 'persisted' END AS outcome,
  CASE WHEN o_orderstatus = 'F' THEN 'inbox' WHEN o_totalprice < 20000 THEN 'supersede' ELSE 'call' END AS step FROM orders
""")
def _(t):
    steps = [("inbox", F.col("o_orderstatus") == "F", "duplicate"), ("supersede", F.col("o_totalprice") < 20000, "superseded"), ("call", F.col("o_orderpriority").startswith("5"), "retry")]
    return quality.run_steps(t("orders"), steps, "persisted").select("o_orderkey", "outcome", "step")


@R.query("request_budget", "SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) <= 3 AS admitted FROM events")
def _(t):
    rows = t("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return E.within_budget(rows, "user_id", "ts", "1 day", 3, "event_id").select("event_id", "admitted")


def _streams(registry: Registry) -> None:
    """Streams over several files, so that there are several batches."""

    def files(spark, sf_dir):
        path = folder(spark, "files")
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        events.repartitionByRange(4, "event_id").write.parquet(path)
        return S.file_stream(spark, path, files_per_batch=1)

    def batches(spark, sf_dir):
        rows = S.run_to_end(files(spark, sf_dir).select("event_id"), "append")
        return rows.agg(F.count_distinct("batch").alias("n_batches"), F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_different"))

    def enriched(spark, sf_dir):
        history = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n_known"))
        home = folder(spark, "enriched")

        def emit(batch, number):
            joined = batch.join(history, "user_id", "left").select("event_id", "user_id", "first_id", "n_known")
            sinks.write_batch(batch, number, {"rows": joined}, home)

        S.run_to_end(files(spark, sf_dir).select("event_id", "user_id"), "append", emit)
        return spark.read.parquet(f"{home}/rows").select("event_id", "user_id", "first_id", "n_known")

    registry.queries |= {"stream_batches": batches, "stream_enriched": enriched}
    registry.sql |= {
        "stream_batches": "SELECT 4 AS n_batches, count(*) AS n, count(DISTINCT event_id) AS n_different FROM events",
        "stream_enriched": "SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id) AS first_id, count(*) OVER (PARTITION BY user_id) AS n_known FROM events",
    }


_streams(R)
