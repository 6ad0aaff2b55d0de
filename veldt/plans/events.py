"""Queries over event feeds, cursors, time series and their streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import events as E
from veldt.operators import timeseries
from veldt.plans.registry import Registry
from veldt.sources import tables
from veldt.streaming import events as S

R = Registry()
STATES = {"signup": 0, "view": 1, "click": 2, "purchase": 3, "error": 4}


def twice(t):
    """Every event once, and large ones again later; entity and revision come from user and amount."""
    one = t("events").select("event_id", "user_id", F.floor("value").cast("long").alias("rev"), F.col("event_id").alias("ord"))
    again = t("events").where("value > 30").select("event_id", "user_id", F.floor("value").cast("long").alias("rev"), (F.col("event_id") + 10_000_000_000).alias("ord"))
    return one.unionByName(again)


@R.query("dedup_classify", """
WITH a AS (SELECT event_id, user_id, floor(value)::BIGINT AS rev, event_id AS ord FROM events UNION ALL SELECT event_id, user_id, floor(value)::BIGINT, event_id + 10000000000 FROM events WHERE value > 30),
f AS (SELECT *, ord = min(ord) OVER (PARTITION BY event_id) AS fresh FROM a), o AS (SELECT *, min(ord) FILTER (WHERE fresh) OVER (PARTITION BY user_id, rev) AS owner FROM f)
SELECT ord, CASE WHEN NOT fresh THEN 'deduplicated' WHEN ord = owner THEN 'persisted' ELSE 'conflict' END AS outcome FROM o
""")
def _(t):
    return E.classify(twice(t), "event_id", "user_id", "rev", "ord").select("ord", "outcome")


@R.query("upsert_cursor", """
SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id
""")
def _(t):
    rows = t("events").select("user_id", "event_id", "ts")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old = rows.where(F.col("ts") >= cut).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return E.upsert_greatest(old, rows.where(F.col("ts") < cut), "user_id", "event_id")


@R.query("upsert_latest", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def _(t):
    rows = t("events").select("user_id", "ts", "event_id", "event_type")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return E.upsert_latest(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), "user_id", ["ts", "event_id"]).drop("ts")


@R.query("conditional_upsert", """
SELECT x.o_custkey AS key, x.v, CASE WHEN c.c_custkey IS NULL THEN 'inserted' WHEN c.c_mktsegment = x.scope THEN 'updated' ELSE 'not_found' END AS status
FROM (SELECT o_custkey, max(o_totalprice) AS v, CASE WHEN max(o_totalprice) > 300000 THEN 'BUILDING' ELSE 'MACHINERY' END AS scope FROM orders GROUP BY o_custkey) x LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = x.o_custkey
""")
def _(t):
    new = t("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("v"))
    new = new.withColumn("scope", F.when(F.col("v") > 300000, "BUILDING").otherwise("MACHINERY"))
    old = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("scope"))
    return E.conditional_upsert(old, new, "key", "scope", "v")


@R.query("insert_absent", """
SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) GROUP BY o_custkey
""")
def _(t):
    orders = t("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return E.insert_absent(orders.where("o_totalprice > 480000"), orders, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


def readers(t):
    users = t("events").groupBy("user_id").agg(F.max("value").alias("top"), F.min("event_type").alias("kind"), F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("cursor"))
    people = users.select((F.col("user_id") % 7).alias("grp"), "user_id", "top")
    return people, users.where("top < 200").select("user_id", "cursor")


READERS = """
u AS (SELECT user_id, user_id % 7 AS grp, max(value) AS top, max(event_id) FILTER (WHERE event_type = 'click') AS cur FROM events GROUP BY user_id),
j AS (SELECT *, CASE WHEN top < 200 THEN cur END AS c FROM u)
"""


@R.query("reader_low_watermark", f"WITH {READERS} SELECT grp, min(coalesce(c, 0)) FILTER (WHERE top > 150) AS floor, count(*) FILTER (WHERE top > 150) AS n_readers FROM j GROUP BY grp")
def _(t):
    people, cursors = readers(t)
    return E.low_watermarks(people, cursors, "grp", "user_id", "cursor", F.col("top") > 150)


@R.query("held_back_reader", f"WITH {READERS} SELECT grp, user_id, coalesce(c, 0) AS cursor FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY coalesce(c, 0), user_id) AS rn FROM j) WHERE rn = 1")
def _(t):
    people, cursors = readers(t)
    return E.held_back(people, cursors, "grp", "user_id", "cursor")


@R.query("archive_split", """
WITH f AS (SELECT grp, min(c) AS floor FROM (SELECT user_id % 7 AS grp, user_id, max(event_id) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1, 2) WHERE grp < 5 GROUP BY grp)
SELECT archived, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM (SELECT event_id, ts < TIMESTAMP '2024-01-20' AND (floor IS NULL OR event_id <= floor) AS archived FROM events e LEFT JOIN f ON f.grp = e.user_id % 7) GROUP BY archived
""")
def _(t):
    rows = t("events").withColumn("grp", F.col("user_id") % 7)
    per = rows.groupBy("grp", "user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("c"))
    floors = per.where("grp < 5").groupBy("grp").agg(F.min("c").alias("floor"))
    done = E.split_archive(rows, floors, "grp", "event_id", "ts", F.lit("2024-01-20").cast("timestamp_ntz"))
    return done.groupBy("archived").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


@R.query("retry_route", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN user_id % 4 = 0 THEN 'retry-30s' WHEN user_id % 4 = 1 THEN 'retry-5m' ELSE 'dead' END AS target,
  CASE WHEN event_type <> 'error' THEN 0 WHEN user_id % 4 = 0 THEN 30 WHEN user_id % 4 = 1 THEN 300 ELSE 0 END AS delay FROM events
""")
def _(t):
    target, delay = E.route(F.col("user_id") % 4, F.col("event_type") == "error", [("retry-30s", 30), ("retry-5m", 300)])
    return t("events").select("event_id", target.alias("target"), delay.alias("delay"))


@R.query("delayed_due", """
SELECT count(*) FILTER (WHERE ts + INTERVAL 300 SECONDS <= TIMESTAMP '2024-01-10') AS n_due, count(*) FILTER (WHERE ts + INTERVAL 300 SECONDS > TIMESTAMP '2024-01-10') AS n_wait FROM events
""")
def _(t):
    ready, waiting = S.due(t("events").withColumn("delay", F.lit(300)), "ts", "delay", "2024-01-10")
    both = ready.select(F.lit(1).alias("d")).unionByName(waiting.select(F.lit(0).alias("d")))
    return both.agg(F.count_if(F.col("d") == 1).alias("n_due"), F.count_if(F.col("d") == 0).alias("n_wait"))


@R.query("dead_letters", "SELECT event_id, 'no amount' AS dlq_reason FROM events WHERE value < 1")
def _(t):
    _good, bad = E.split_bad(t("events").select("event_id", "value"), F.when(F.col("value") < 1, "no amount"))
    return bad.select("event_id", "dlq_reason")


@R.query("state_machine_fold", """
SELECT user_id, arg_max(event_type, k) AS state, count(DISTINCT k) AS n_moves FROM (SELECT *, list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) AS k FROM events) GROUP BY user_id
""")
def _(t):
    return E.furthest_state(t("events"), "user_id", "event_type", STATES)


@R.query("state_machine_fold_whole")
def _(t):
    return E.furthest_state(t("events"), "user_id", "event_type", STATES)


@R.query("family_lifetimes", """
SELECT user_id, epoch_us(min(ts)) AS first_us, arg_max_null(CASE WHEN event_type <> 'error' THEN epoch_us(ts) END, ts) AS last_us, count(*) AS n FROM events GROUP BY user_id
""")
def _(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t("events").select("user_id", at.alias("at"), F.when(F.col("event_type") != "error", at).alias("end"))
    return E.lifetimes(rows, "user_id", "at", "end").select("user_id", F.col("first_start").alias("first_us"), F.col("last_end").alias("last_us"), "n")


@R.query("drain_time", """
WITH l AS (SELECT epoch_us(ts) AS tm, greatest(0, floor(value) - 200)::BIGINT AS lg FROM events WHERE event_type = 'click'), b AS (SELECT max(lg) AS max_lag, min(tm) FILTER (WHERE lg > 0) AS first_busy, max(tm) FILTER (WHERE lg > 0) AS lst FROM l)
SELECT max_lag, first_busy, (SELECT min(tm) FROM l WHERE lg = 0 AND tm > lst) AS drained FROM b
""")
def _(t):
    rows = t("events").where("event_type = 'click'").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.greatest(F.lit(0), F.floor("value") - 200).alias("lag"))
    return E.drain_time(rows, "at", "lag")


@R.query("tumbling_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    found = timeseries.windowed_counts(t("events"), "ts", "1 hour", None, ["event_type"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)})
    return found.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n", "total")


@R.query("sliding_rate", """
SELECT start_us, round(count(*) / 7200.0::DOUBLE, 9) AS per_second FROM (SELECT unnest([epoch_us(time_bucket(INTERVAL 1 HOUR, ts)), epoch_us(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR)]) AS start_us FROM events) GROUP BY start_us
""")
def _(t):
    found = timeseries.windowed_counts(t("events"), "ts", "2 hours", "1 hour", [], {"per_second": F.round(F.count(F.lit(1)) / 7200, 9)})
    return found.select(F.unix_micros("window_start").alias("start_us"), "per_second")


@R.query("counter_rate", """
WITH s AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events)
SELECT user_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, round(sum(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END) / 86400, 9) AS rate FROM s GROUP BY 1, 2
""")
def _(t):
    found = timeseries.rate(t("events").select("user_id", "ts", "value"), ["user_id"], "ts", "value", 86400)
    return found.select("user_id", F.unix_micros("window_start").alias("start_us"), F.round("rate", 9).alias("rate"))


@R.query("range_increases", """
WITH s AS (SELECT user_id, ts, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
g AS (SELECT *, CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END AS up FROM s),
c AS (SELECT *, sum(up) OVER (PARTITION BY user_id ORDER BY ts) AS upto FROM g)
SELECT event_id, round(upto - first_value(upto) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW), 6) AS increase FROM c
""")
def _(t):
    found = timeseries.range_increases(t("events").select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", 2 * 86400)
    return found.select("event_id", F.round("increase", 6).alias("increase"))


@R.query("session_gaps", """
WITH b AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM b)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, k
""")
def _(t):
    found = timeseries.sessions(t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 6 * 3600)
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@R.query("histogram_quantile", """
WITH l AS (SELECT unnest([10, 50, 100, 200, 'inf'::DOUBLE]) AS le), k AS (SELECT DISTINCT event_type FROM events),
c AS (SELECT k.event_type, le, (SELECT count(*) FROM events e WHERE e.event_type = k.event_type AND e.value <= le) AS n FROM k, l),
w AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS low, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY le), 0) AS below, 0.95::DOUBLE * max(n) OVER (PARTITION BY event_type) AS r FROM c)
SELECT event_type, round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (r - below) / (n - below) END, le), 6) AS quantile FROM w WHERE n >= r AND below < r GROUP BY event_type
""")
def _(t):
    buckets = timeseries.bucket_counts(t("events"), ["event_type"], "value", [10, 50, 100, 200])
    return timeseries.histogram_quantile(buckets, ["event_type"], 0.95).withColumn("quantile", F.round("quantile", 6))


@R.query("optional_filters", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7")
def _(t):
    return tables.optional(t("events"), event_type="click", user_id=7, value=None).select("event_id")


@R.query("retention_policy", "SELECT event_type, CASE WHEN min(event_id) > 2 THEN max(user_id) + 24 END AS keep_hours FROM events GROUP BY event_type")
def _(t):
    per = t("events").groupBy("event_type").agg(F.min("event_id").alias("low"), F.max("user_id").alias("longest"))
    return per.select("event_type", E.retention(F.when(F.col("low") > 2, F.col("longest")).otherwise(F.lit(-1)), F.lit(24)).alias("keep_hours"))


def register_streams(registry: Registry) -> None:
    """Streams read the file of a table as it is; their last rows equal those of the batch twins."""

    def of(spark, sf_dir):
        path = f"{sf_dir.rstrip('/')}/events.parquet"
        # a single file is only taken through a pattern
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")

    def dedup(spark, sf_dir):
        return S.run_to_end(S.first_of(of(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"]), "append").drop("batch")

    def supersede(spark, sf_dir):
        rows = S.run_to_end(S.highest(of(spark, sf_dir), "user_id", "event_id"), "update")
        return rows.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max("n").alias("n"))

    def states(spark, sf_dir):
        stream = of(spark, sf_dir).select("user_id", F.col("event_type").alias("state"))
        rows = S.run_to_end(S.furthest_state(stream, "user_id", "state", STATES), "update")
        return rows.groupBy("user_id").agg(F.max_by("state", "batch").alias("state"))

    def windows(spark, sf_dir):
        # a window of the last hours stays open in append mode; update mode shows all
        rows = S.run_to_end(S.windowed(of(spark, sf_dir), "ts", "1 hour", "60 seconds", ["event_type"]), "update")
        return rows.groupBy("event_type", "window_start").agg(F.max("n").alias("n")).select("event_type", F.unix_micros("window_start").alias("start_us"), "n")

    registry.queries |= {"stream_dedup": dedup, "stream_supersede": supersede, "stream_states": states, "stream_windows": windows}
    registry.sql |= {
        "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
        "stream_supersede": "SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id",
        "stream_states": "SELECT user_id, arg_max(event_type, list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type)) AS state FROM events GROUP BY user_id",
        "stream_windows": "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2",
    }


register_streams(R)
