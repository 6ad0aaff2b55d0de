"""Queries of timed state, the partitioned log and the sink of transactions."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators import events as E
from veldt.operators.shared import scratch
from veldt.plans.registry import Registry
from veldt.sources import commits, log
from veldt.streaming import events as S
from veldt.streaming import timed

R = Registry()

#: Events lie hours apart; the time of these queries runs so much faster that leases and waits of minutes matter.
FASTER = 240
KIND = """CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' AND value > 60 THEN 'accepted' WHEN event_type = 'purchase' AND value > 80 THEN 'complete'
  WHEN event_type = 'signup' AND value > 90 THEN 'superseded' ELSE 'lease' END"""
FAILS = "CASE WHEN event_type = 'error' THEN user_id % 5 ELSE 0 END"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/veldt-{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    # a single file is only taken through a pattern
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("at", F.expr(f"unix_micros(cast(ts AS timestamp)) div {1000 * FASTER}"))


def lease_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select("user_id", "at", F.expr(KIND).alias("kind"))
    found = S.run_to_end(timed.leases(rows, "user_id", "at", "kind"), "update")
    last = F.max_by(F.struct("status", "attempts", "expired"), F.struct("at_ms", "batch"))
    return found.groupBy("user_id").agg(last.alias("s")).select("user_id", "s.status", "s.attempts", "s.expired")


def retry_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select("user_id", "event_id", "at", F.expr(FAILS).alias("fails"))
    found = S.run_to_end(timed.retries(rows, "user_id", "event_id", "at", "fails", lambda fails, attempts: attempts >= fails), "append")
    return found.select("event_id", "outcome", "attempts", "at_ms")


def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of four partitions, read in batches of admitted rows, then rewound to a time and read again into the same rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", F.expr("unix_micros(cast(ts AS timestamp))").alias("at"))
    home = _folder(spark, "log")
    log.append(events, home, F.col("user_id") % 4, ["at", "event_id"], 4)
    rows: list[DataFrame] = []
    since = int(datetime.datetime(2024, 1, 20, tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    for start in (None, log.rewind(home, "at", since)):
        checkpoint = _folder(spark, "log-reader")
        stream = log.read_stream(spark, home, events.schema, checkpoint, admit=10_000, start=start)
        log.consume(stream, checkpoint, lambda batch, number, to=checkpoint: batch.write.mode("overwrite").parquet(f"{to}/out/batch={number}"))
        rows.append(spark.read.parquet(f"{checkpoint}/out").drop("batch"))
    again = rows[1].groupBy("log_part").agg(F.count(F.lit(1)).alias("n_again"))
    once = rows[0].unionByName(rows[1]).dropDuplicates(["log_part", "log_offset"])
    first = once.groupBy("log_part").agg(
        F.count(F.lit(1)).alias("n"), F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"), F.max_by("event_id", "log_offset").alias("last_event"), F.round(F.sum("value"), 2).alias("total")
    )
    return first.join(again, "log_part", "left").select("log_part", "n", "first_offset", "last_offset", "last_event", "total", F.coalesce("n_again", F.lit(0)).alias("n_again"))


def commit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers race for the key of a user and day: two transactions of two tables each, the second beside what the first has saved."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    answers = events.select("event_id", "ts", F.concat_ws(":", "user_id", F.to_date("ts")).alias("claim"), F.col("event_type").alias("stable"), F.floor("value").alias("body"))
    home, kept = _folder(spark, "commits"), "claim string, stable string, body long, event_id long"
    found = []
    for number, part in enumerate((F.col("ts") < F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), F.col("ts") >= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))):
        judged = E.save_outcomes(answers.where(part), commits.committed(spark, home, "requests", kept), "claim", "stable", "body", "event_id")
        saved = judged.where("outcome = 'saved'").select("claim", "stable", "body", "event_id")
        for _ in range(2):  # a transaction that is sent again changes nothing
            commits.save({"requests": saved, "audit": judged.select("event_id", "outcome")}, home, f"t{number}")
        found = [commits.committed(spark, home, "audit", "event_id long, outcome string").groupBy("outcome").count(), commits.committed(spark, home, "requests", kept)]
    stored = found[1].agg(F.lit("stored").alias("outcome"), F.count(F.lit(1)).alias("count"))
    return found[0].unionByName(stored).withColumnRenamed("count", "n")


R.queries |= {"lease_states": lease_states, "retry_timers": retry_timers, "log_replay": log_replay, "commit_outcomes": commit_outcomes}
R.sql |= {
    "lease_states": f"""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // {1000 * FASTER} AS tm, {KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, 'pending' AS status, NULL::BIGINT AS expires, 0::BIGINT AS attempts, 0::BIGINT AS expired FROM events
  UNION ALL
  SELECT user_id, k,
    CASE WHEN kind = 'lease' AND s = 'pending' THEN 'in_flight' WHEN kind = 'failed' AND s = 'in_flight' THEN 'pending' WHEN kind = 'accepted' AND s IN ('pending', 'in_flight') THEN kind
      WHEN kind = 'complete' OR (kind = 'superseded' AND s <> 'complete') THEN kind ELSE s END,
    CASE WHEN kind = 'lease' AND s = 'pending' THEN tm + 120000 WHEN kind = 'lease' OR (kind = 'accepted' AND s NOT IN ('pending', 'in_flight')) THEN x WHEN s = 'in_flight' THEN NULL ELSE x END,
    attempts + CASE WHEN kind = 'lease' AND s = 'pending' THEN 1 ELSE 0 END, expired + ran::INT
  FROM (SELECT e.*, attempts, expired, coalesce(expires <= tm, false) AS ran, CASE WHEN coalesce(expires <= tm, false) THEN 'pending' ELSE status END AS s,
          CASE WHEN coalesce(expires <= tm, false) THEN NULL ELSE expires END AS x FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
), l AS (SELECT user_id, arg_max(status, k) AS status, arg_max_null(expires, k) AS expires, arg_max(attempts, k) AS attempts, arg_max(expired, k) AS expired FROM f GROUP BY user_id),
m AS (SELECT *, coalesce(expires <= (SELECT max(tm) FROM e), false) AS ran FROM l)
SELECT user_id, CASE WHEN ran THEN 'pending' ELSE status END AS status, attempts, (expired + ran::INT)::BIGINT AS expired FROM m
""",
    "retry_timers": f"""
WITH e AS (SELECT event_id, epoch_us(ts) // {1000 * FASTER} AS tm, {FAILS} AS fails FROM events), d AS (SELECT *, tm + CASE fails WHEN 0 THEN 0 WHEN 1 THEN 30000 ELSE 330000 END AS at_ms FROM e)
SELECT event_id, CASE WHEN fails < 3 THEN 'done' ELSE 'dead' END AS outcome, least(fails, 2) + 1 AS attempts, at_ms FROM d WHERE at_ms <= (SELECT max(tm) FROM e)
""",
    "log_replay": """
SELECT (user_id % 4)::INT AS log_part, count(*) AS n, 0::BIGINT AS first_offset, count(*) - 1 AS last_offset, arg_max(event_id, (ts, event_id)) AS last_event, round(sum(value), 2) AS total,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS n_again FROM events GROUP BY 1
""",
    "commit_outcomes": """
WITH a AS (SELECT event_id, user_id || ':' || ts::DATE AS claim, event_type AS stable, floor(value)::BIGINT AS body, ts < TIMESTAMP '2024-01-15 12:00:00' AS early FROM events),
o AS (SELECT *, first_value(stable) OVER (PARTITION BY claim ORDER BY NOT early, event_id) AS own, row_number() OVER (PARTITION BY claim, stable, body ORDER BY NOT early, event_id) AS place FROM a),
r AS (SELECT CASE WHEN stable <> own THEN 'conflict' WHEN place = 1 THEN 'saved' ELSE 'already_answered' END AS outcome FROM o)
SELECT outcome, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'stored', count(*) FROM r WHERE outcome = 'saved'
""",
}
