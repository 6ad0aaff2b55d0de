"""Queries that aggregate, evaluate scores and check rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import numbers
from veldt.operators import evaluation, ordering, quality, stats
from veldt.plans.registry import Registry
from veldt.sources.sinks import manifest

R = Registry()
STAGES = ["signup", "view", "click", "purchase"]


def scored(t):
    """Labels with a made score: how long the text is; truth is toxicity, the group the language."""
    docs = t("documents").select("doc_id", "lang", "n_chars")
    return t("labels").join(docs, "doc_id").select("doc_id", "lang", "quality", "toxic", F.round(F.col("n_chars") / 20000, 6).alias("score"))


SCORED = "SELECT l.doc_id, d.lang, l.quality, l.toxic, round(d.n_chars / 20000.0::DOUBLE, 6) AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


@R.query("stage_completeness", """
SELECT user_id, epoch_us(min(ts) FILTER (WHERE event_type = 'view')) AS view_us, epoch_us(min(ts) FILTER (WHERE event_type = 'purchase')) AS purchase_us,
  count(*) FILTER (WHERE event_type = 'click') AS click_n, array_to_string(list_filter(['signup', 'view', 'click', 'purchase'], lambda s: NOT list_contains(list(DISTINCT event_type), s)), ',') AS missing,
  len(list_filter(['signup', 'view', 'click', 'purchase'], lambda s: NOT list_contains(list(DISTINCT event_type), s))) = 0 AS complete
FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-03' GROUP BY user_id
""")
def _(t):
    rows = t("events").where(F.col("ts").between(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-03").cast("timestamp_ntz")))
    found = stats.stage_times(rows, "user_id", "event_type", "ts", STAGES)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.select("user_id", us("view_at").alias("view_us"), us("purchase_at").alias("purchase_us"), "click_n", "missing", "complete")


@R.query("latency_percentiles", """
WITH p AS (SELECT user_id, (epoch_us(min(ts) FILTER (WHERE event_type = 'purchase')) - epoch_us(min(ts) FILTER (WHERE event_type = 'view'))) // 1000 AS ms FROM events GROUP BY user_id),
v AS (SELECT list_sort(list(ms)) AS l, count(ms) AS n FROM p WHERE ms IS NOT NULL)
SELECT n AS n_values, l[greatest(1, least(n, round_even(0.5 * n + 0.5, 0)::BIGINT))] AS p50_even, l[greatest(1, least(n, ceil(0.5 * n)::BIGINT))] AS p50_ceil,
  l[greatest(1, least(n, round_even(0.95 * n + 0.5, 0)::BIGINT))] AS p95_even, l[greatest(1, least(n, ceil(0.95 * n)::BIGINT))] AS p95_ceil FROM v
""")
def _(t):
    first = lambda s: F.min(F.when(F.col("event_type") == s, F.unix_micros(F.col("ts").cast("timestamp"))))
    # whole milliseconds, cut towards zero
    per = t("events").groupBy("user_id").agg((first("purchase") - first("view")).alias("us")).select("user_id", F.expr("us div 1000").alias("ms"))
    return stats.percentiles(per, [], "ms", {"p50": 0.5, "p95": 0.95}).drop("p50_linear", "p95_linear")


@R.query("percentiles_three_ways", """
WITH v AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS l, count(*) AS n, quantile_cont(l_extendedprice, 0.95) AS lin FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, n AS n_values, l[greatest(1, least(n, round_even(0.95 * n + 0.5, 0)::BIGINT))] AS p95_even, l[greatest(1, least(n, ceil(0.95 * n)::BIGINT))] AS p95_ceil, round(lin, 4) AS p95_linear FROM v
""")
def _(t):
    return stats.percentiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", {"p95": 0.95}).withColumn("p95_linear", F.round("p95_linear", 4))


@R.query("filtered_counts", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE event_type IS DISTINCT FROM 'error' AND value > 50) AS n_large,
  round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS mean_purchase, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id
""")
def _(t):
    kind = F.col("event_type")
    return t("events").groupBy("user_id").agg(
        stats.count_where(kind == "error").alias("n_error"),
        stats.count_where(~kind.eqNullSafe("error") & (F.col("value") > 50)).alias("n_large"),
        F.round(F.avg(F.when(kind == "purchase", F.col("value"))), 6).alias("mean_purchase"),
        F.count_distinct("event_type").alias("n_types"),
    )


def failure_shares(rows):
    kind = F.col("event_type")
    return rows.groupBy("user_id").agg(F.round(stats.ratio(stats.count_where(kind == "error"), stats.count_where(kind.isin("error", "signup"))), 6).alias("failure_share"))


@R.query("guarded_ratio", """
SELECT user_id, round(count(*) FILTER (WHERE event_type = 'error') / nullif(count(*) FILTER (WHERE event_type IN ('error', 'signup')), 0), 6) AS failure_share FROM events GROUP BY user_id
""")
def _(t):
    return failure_shares(t("events"))


@R.query("guarded_ratio_whole")
def _(t):
    return failure_shares(t("events"))


@R.query("duplicate_accounting", """
SELECT count(*) AS n_rows, count(DISTINCT sha256(text)) AS n_distinct, count(*) - count(DISTINCT sha256(text)) AS n_extra,
  (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY sha256(text) HAVING count(*) > 1)) AS n_groups FROM documents
""")
def _(t):
    return stats.duplicate_counts(t("documents"), F.sha2("text", 256))


@R.query("size_histogram", "SELECT size, count(*) AS n_keys FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size")
def _(t):
    return stats.size_histogram(t("lineitem"), "l_orderkey")


@R.query("median_spread", """
SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median_quantity, round(stddev_samp(l_quantity), 6) AS spread, round(1 - stddev_pop(l_quantity) / max(l_quantity), 6) AS reduction FROM lineitem GROUP BY l_returnflag
""")
def _(t):
    middle = stats.percentiles(t("lineitem"), ["l_returnflag"], "l_quantity", {"m": 0.5}).select("l_returnflag", F.round("m_linear", 6).alias("median_quantity"))
    rest = t("lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("spread"), F.round(1 - F.stddev_pop("l_quantity") / F.max("l_quantity"), 6).alias("reduction"))
    return middle.join(rest, "l_returnflag")


@R.query("stats_bundle", """
SELECT event_type, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high, floor(sum(value) / count(*))::BIGINT AS floor_mean, sum(greatest(0, value - 100))::BIGINT AS excess FROM events GROUP BY event_type
""")
def _(t):
    return t("events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"),
        F.floor(F.sum("value") / F.count(F.lit(1))).cast("long").alias("floor_mean"), F.round(F.sum(F.greatest(F.lit(0.0), F.col("value") - 100))).cast("long").alias("excess"),
    )


@R.query("ordered_arrays", """
SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, greatest(max(value) FILTER (WHERE event_type = 'view'), max(value) FILTER (WHERE event_type = 'click')) AS top FROM events GROUP BY user_id
""")
def _(t):
    most = lambda s: F.max(F.when(F.col("event_type") == s, F.col("value")))
    return t("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.greatest(most("view"), most("click")).alias("top"))


@R.query("having_duplicates", "SELECT o_custkey, o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return t("orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@R.query("table_fingerprint", """
SELECT count(*) AS n_rows, sha256(string_agg(concat_ws('|', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR), chr(10) ORDER BY n_nationkey)) AS fingerprint FROM nation
""")
def _(t):
    return stats.fingerprint(t("nation"), ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey")


@R.query("table_fingerprint_unordered", """
WITH m AS (SELECT md5(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority)) AS h FROM orders)
SELECT count(*) AS n_rows, sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR AS low_sum, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR AS high_sum FROM m
""")
def _(t):
    return stats.fingerprint_unordered(t("orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@R.query("manifest_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {n})) AS n_columns" for n in ("region", "nation", "customer", "orders", "events", "documents")
))
def _(t):
    return manifest({n: t(n) for n in ("region", "nation", "customer", "orders", "events", "documents")})


@R.query("running_share", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey) / sum(o_totalprice) OVER (), 6) AS share FROM orders
""")
def _(t):
    rows = t("orders").select("o_orderkey", "o_totalprice")
    total = rows.agg(F.sum("o_totalprice").alias("total"))  # one row
    found = ordering.running_totals(rows, [], "o_orderkey", F.col("o_totalprice")).crossJoin(F.broadcast(total))
    return found.select("o_orderkey", F.round(F.col("running") / F.col("total"), 6).alias("share"))


@R.query("least_squares", """
SELECT round((sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz), 4) AS c_l_quantity, round((szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz), 2) AS c_l_discount
FROM (SELECT sum(l_quantity * l_quantity) AS sxx, sum(l_discount * l_discount) AS szz, sum(l_quantity * l_discount) AS sxz, sum(l_quantity * l_extendedprice) AS sxy, sum(l_discount * l_extendedprice) AS szy FROM lineitem)
""")
def _(t):
    found = stats.least_squares(t("lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return found.select(F.round("c_l_quantity", 4).alias("c_l_quantity"), F.round("c_l_discount", 2).alias("c_l_discount"))


@R.query("auroc_by_group", f"""
WITH s AS ({SCORED}), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM s),
a AS (SELECT lang, sum(toxic)::BIGINT AS n_pos, (count(*) - sum(toxic))::BIGINT AS n_neg, sum(rk) FILTER (WHERE toxic = 1) AS sr FROM r GROUP BY lang)
SELECT lang, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round(((sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg))::DOUBLE, 6) END AS auroc FROM a
""")
def _(t):
    return evaluation.auroc(scored(t), "toxic", "score", ["lang"]).withColumn("auroc", F.round("auroc", 6))


@R.query("rates_at_threshold", f"""
WITH s AS ({SCORED}) SELECT lang, count(*) AS n, round(count(*) FILTER (WHERE (score >= 0.1) = (toxic = 1)) / count(*), 6) AS accuracy,
  round(count(*) FILTER (WHERE score >= 0.1 AND toxic = 1) / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS sensitivity,
  round(count(*) FILTER (WHERE score < 0.1 AND toxic = 0) / nullif(count(*) FILTER (WHERE toxic = 0), 0), 6) AS specificity FROM s GROUP BY lang
""")
def _(t):
    found = evaluation.rates_at(scored(t), "toxic", "score", 0.1, ["lang"])
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "sensitivity", "specificity")})


@R.query("fairness_report", f"""
WITH s AS ({SCORED}), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM s),
a AS (SELECT lang, sum(toxic) AS p, count(*) - sum(toxic) AS q, sum(rk) FILTER (WHERE toxic = 1) AS sr,
  count(*) FILTER (WHERE score >= 0.1 AND toxic = 1) / nullif(sum(toxic), 0) AS sens, count(*) FILTER (WHERE score < 0.1 AND toxic = 0) / nullif(count(*) - sum(toxic), 0) AS spec FROM r GROUP BY lang),
g AS (SELECT count(*) AS n_groups, max(u) - min(u) AS ag, max(sens) - min(sens) AS sg, max(spec) - min(spec) AS pg FROM (SELECT *, CASE WHEN p > 0 AND q > 0 THEN ((sr - p * (p + 1) / 2.0) / (p * q))::DOUBLE END AS u FROM a))
SELECT n_groups, round(ag, 6) AS auroc_gap, round(sg, 6) AS sensitivity_gap, round(pg, 6) AS specificity_gap, round(greatest(sg, pg), 6) AS odds_gap,
  CASE WHEN ag IS NULL OR sg IS NULL OR pg IS NULL THEN 'UNCLEAR' WHEN ag <= 0.01 AND greatest(sg, pg) <= 0.03 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g
""")
def _(t):
    found = evaluation.gap_report(scored(t), "toxic", "score", "lang", 0.1)
    return found.withColumns({c: F.round(c, 6) for c in ("auroc_gap", "sensitivity_gap", "specificity_gap", "odds_gap")})


@R.query("confusion_matrix", f"""
WITH s AS ({SCORED}) SELECT quality AS truth, (score < 0.3)::INT AS predicted, count(*) AS n, abs(quality - (score < 0.3)::INT) <= 1 AS within_one FROM s GROUP BY 1, 2
""")
def _(t):
    return evaluation.confusion(scored(t), F.col("quality"), (F.col("score") < 0.3).cast("int"))


@R.query("threshold_sweep", f"""
WITH s AS ({SCORED}), p AS (SELECT unnest([0.01, 0.05, 0.1, 0.2, 0.4])::DOUBLE AS threshold),
m AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS n_pred, count(*) FILTER (WHERE score >= threshold AND toxic = 1) AS hits,
  (count(*) FILTER (WHERE score >= threshold AND toxic = 1) / sum(toxic) + count(*) FILTER (WHERE score < threshold AND toxic = 0) / (count(*) - sum(toxic))) / 2 AS b FROM s, p GROUP BY threshold)
SELECT threshold, n_pred, hits, round(b, 6) AS balanced, row_number() OVER (ORDER BY b DESC, threshold) = 1 AS best FROM m
""")
def _(t):
    return evaluation.threshold_sweep(scored(t), "toxic", "score", [0.01, 0.05, 0.1, 0.2, 0.4]).withColumn("balanced", F.round("balanced", 6))


@R.query("bin_summary", f"""
WITH s AS ({SCORED}) SELECT (score >= 0.01)::BIGINT + (score >= 0.05)::BIGINT + (score >= 0.2)::BIGINT AS bin, count(*) AS n, round(avg(quality), 6) AS mean_quality, round(avg(score), 6) AS mean_score FROM s GROUP BY 1
""")
def _(t):
    return evaluation.bin_summary(scored(t), "score", [0.01, 0.05, 0.2], {"mean_quality": F.round(F.avg("quality"), 6), "mean_score": F.round(F.avg("score"), 6)})


@R.query("bootstrap_ci", """
WITH e AS (SELECT doc_id, quality, r, ('0x' || substr(md5(doc_id::VARCHAR || ':' || (r // 4)::VARCHAR), 1 + 8 * (r % 4)::INT, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM labels, range(200) t(r)),
w AS (SELECT *, len(list_filter([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998980]::DOUBLE[], lambda p: p <= u)) AS w FROM e),
m AS (SELECT r, sum(quality * w) / nullif(sum(w), 0) AS m FROM w GROUP BY r)
SELECT round((SELECT avg(quality) FROM labels), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m
""")
def _(t):
    return evaluation.bootstrap_mean(t("labels"), "doc_id", "quality", 200).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@R.query("vote_argmax", """
WITH m AS (SELECT user_id, ascii(event_type) AS kind, avg(value) AS mean FROM events GROUP BY 1, 2)
SELECT user_id, kind, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, kind) AS rn FROM m) WHERE rn = 1
""")
def _(t):
    votes = t("events").select("user_id", F.ascii("event_type").alias("kind"), "value")
    return evaluation.vote(votes, "user_id", "kind", "value").withColumn("mean", F.round("mean", 6))


@R.query("rule_violations", """
SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest([CASE WHEN NOT (o_totalprice < 400000) THEN 'price limit' END, CASE WHEN NOT (o_orderstatus <> 'F' OR o_orderdate < TIMESTAMP '2000-01-01') THEN 'final is old' END,
  CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$') THEN 'priority format' END, CASE WHEN NOT ((o_orderstatus = 'P') <> (o_totalprice > 50000)) THEN 'one of two' END]) AS rule FROM orders) WHERE rule IS NOT NULL
""")
def _(t):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    rules = {
        "price limit": price < 400000,
        "final is old": quality.implies(status == "F", F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")),
        "priority format": F.col("o_orderpriority").rlike("^[1-5]-[A-Z ]+$"),
        "one of two": quality.exactly_one(status == "P", price > 50000),
    }
    return quality.violations(t("orders"), "o_orderkey", rules)


@R.query("first_problem", """
SELECT event_id, CASE WHEN value > 300 THEN 'too large' WHEN event_type = 'error' THEN 'failed' WHEN json_extract_string(props, '$.k')::INT < 50 THEN 'k too small' END AS problem FROM events
""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    rules = {"too large": F.col("value") <= 300, "failed": F.col("event_type") != "error", "k too small": k >= 50}
    return t("events").select("event_id", quality.first_problem(rules).alias("problem"))


@R.query("unknown_keys", "SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('j'))), ',') AS unknown FROM events")
def _(t):
    return t("events").select("event_id", F.array_join(quality.unknown_keys("props", ["j"]), ",").alias("unknown"))


@R.query("decision_table", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'stop' WHEN o_orderpriority = '1-URGENT' THEN 'stop' WHEN o_orderpriority = '2-HIGH' THEN 'warn' WHEN o_orderstatus = 'P' THEN 'warn' ELSE 'ok' END AS level,
  CASE WHEN o_orderstatus = 'F' THEN 'F' WHEN o_orderpriority = '1-URGENT' THEN '1-URGENT' WHEN o_orderpriority = '2-HIGH' THEN '2-HIGH' WHEN o_orderstatus = 'P' THEN 'P' END AS code FROM orders
""")
def _(t):
    table = [("F", "stop"), ("1-URGENT", "stop"), ("2-HIGH", "warn"), ("P", "warn")]
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("a"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority")).alias("b"))
    return quality.decide(rows, ["a", "b"], table, ["stop", "warn"]).select("o_orderkey", "level", "code")


@R.query("bucketed_classes", """
SELECT c_custkey, CASE WHEN c_acctbal > 7500 THEN 'high' WHEN c_acctbal > 2500 THEN 'middle' ELSE 'low' END AS class, round(degrees(atan2(c_acctbal / 100 - 50, 10)), 6) AS angle FROM customer
""")
def _(t):
    return t("customer").select(
        "c_custkey", quality.bucket(F.col("c_acctbal"), [(7500, "high"), (2500, "middle")], "low").alias("class"), F.round(numbers.hue_angle(F.col("c_acctbal") / 100, F.lit(10.0)), 6).alias("angle")
    )


@R.query("numeric_functions", """
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-0.5 + (l_quantity - 25) / 14 * 0.8 + (l_discount - 0.05) / 0.03 * -0.3))), 6) AS chance, floor(l_discount * 100 * 10 + 0.5) / 10 AS half_up, greatest(10, least(40, l_quantity)) AS clamped,
  round(CASE WHEN l_tax <= 0.04045 THEN l_tax / 12.92 ELSE pow((l_tax + 0.055) / 1.055, 2.4) END, 8) AS linear, least(30.0, 0.5 * pow(2, l_linenumber)) * l_discount AS wait FROM lineitem
""")
def _(t):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(numbers.logistic_score([q, d], [25, 0.05], [14, 0.03], [0.8, -0.3], -0.5), 6).alias("chance"),
        numbers.half_up(d * 100, 1).alias("half_up"), numbers.clamp(q, 10, 40).cast("double").alias("clamped"),
        F.round(numbers.to_linear(F.col("l_tax")), 8).alias("linear"), numbers.backoff(F.col("l_linenumber"), 0.5, 30, d).alias("wait"),
    )
