"""Queries over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.streaming import limits

from .registry import query


@query("token_bucket", "v_log", sql="""WITH RECURSIVE e AS (SELECT event_id, namespace, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY namespace, user_id ORDER BY ts, event_id) AS n FROM v_log),
r AS (SELECT event_id, namespace, user_id, t, n, 0.0::DOUBLE + 1.0 AS tokens, true AS allowed FROM e WHERE n = 1
UNION ALL SELECT e.event_id, e.namespace, e.user_id, e.t, e.n, least(2.0, r.tokens + (e.t - r.t) / 1e6 * 0.00005) - CASE WHEN least(2.0, r.tokens + (e.t - r.t) / 1e6 * 0.00005) >= 1 THEN 1.0 ELSE 0.0 END, least(2.0, r.tokens + (e.t - r.t) / 1e6 * 0.00005) >= 1 FROM r JOIN e ON e.namespace = r.namespace AND e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, allowed FROM r""")
def token_bucket(t: DataFrame) -> DataFrame:
    return limits.token_bucket(t, 0.00005, 2.0)


_NOW = "TIMESTAMP '2024-02-01 02:30:00'"


@query("cache_fresh", "v_log", sql=f"""SELECT event_id, ts - INTERVAL 4 HOUR >= date_trunc('month', {_NOW} - INTERVAL 4 HOUR) AS fresh,
 strftime(least(CAST(date_trunc('month', ts - INTERVAL 4 HOUR) + INTERVAL 1 MONTH AS TIMESTAMP), CAST(date_trunc('week', ts - INTERVAL 4 HOUR) + INTERVAL 7 DAY AS TIMESTAMP)) + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M') AS negative_until FROM v_log""")
def cache_fresh(t: DataFrame) -> DataFrame:
    now = F.expr(_NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    return t.select("event_id", limits.fresh("ts", now).alias("fresh"), F.date_format(limits.negative_expiry("ts"), "yyyy-MM-dd HH:mm").alias("negative_until"))


@query("negative_confirm", "v_log", sql="""WITH i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY namespace, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM v_log)
SELECT event_id, (sum((NOT ok)::INT) OVER (PARTITION BY namespace, user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS streak, sum((NOT ok)::INT) OVER (PARTITION BY namespace, user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 3 AS confirmed FROM i""")
def negative_confirm(t: DataFrame) -> DataFrame:
    return limits.negative_runs(t)


@query("claim_due", "v_log", sql="SELECT namespace, event_id FROM (SELECT namespace, event_id, row_number() OVER (PARTITION BY namespace ORDER BY ts, event_id) AS n FROM v_log WHERE NOT ok AND ts <= TIMESTAMP '2024-01-03 00:00:00') WHERE n <= 16")
def claim_due(t: DataFrame) -> DataFrame:
    due = t.where("not ok and ts <= timestamp_ntz '2024-01-03 00:00:00'")
    return due.withColumn("n", F.row_number().over(W.partitionBy("namespace").orderBy("ts", "event_id"))).where("n <= 16").select("namespace", "event_id")


@query("request_dedup", "v_log", sql="SELECT namespace, props, min(event_id) AS event_id, count(*) AS tasks FROM v_log GROUP BY namespace, props")
def request_dedup(t: DataFrame) -> DataFrame:
    return t.groupBy("namespace", "props").agg(F.min("event_id").alias("event_id"), F.count("*").alias("tasks"))


@query("attempt_outcome", "v_log", sql="""WITH a AS (SELECT user_id, event_id, ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM v_log), f AS (SELECT user_id, min(n) FILTER (ok) AS first_ok FROM a GROUP BY user_id)
SELECT user_id, CASE WHEN first_ok <= 3 THEN 'success' ELSE 'blocked' END AS outcome, least(coalesce(first_ok, 3), 3) AS attempts FROM f""")
def attempt_outcome(t: DataFrame, most: int = 3) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    first = t.withColumn("n", n.cast("long")).groupBy("user_id").agg(F.min(F.when(F.col("ok"), F.col("n"))).alias("first_ok"))
    return first.select("user_id", F.when(F.col("first_ok") <= most, "success").otherwise("blocked").alias("outcome"), F.least(F.coalesce("first_ok", F.lit(most)), F.lit(most)).cast("long").alias("attempts"))


@query("ttl_sessions", "v_log", sql="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM v_log), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ttl_sessions(t: DataFrame) -> DataFrame:
    return limits.sessions(t, "1 hour")


@query("ns_tumbling", "v_log", sql="SELECT namespace, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM v_log GROUP BY ALL")
def ns_tumbling(t: DataFrame) -> DataFrame:
    return limits.windowed(t, "1 hour")


@query("ns_sliding", "v_log", sql="SELECT namespace, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, count(*) AS n FROM v_log, range(2) r(k) GROUP BY ALL")
def ns_sliding(t: DataFrame) -> DataFrame:
    return limits.windowed(t, "1 hour", "30 minutes")


@query("ns_session", "v_log", sql="""WITH g AS (SELECT namespace, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY namespace ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM v_log), s AS (SELECT *, sum(new) OVER (PARTITION BY namespace ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT namespace, min(ts) AS start, count(*) AS n FROM s GROUP BY namespace, k""")
def ns_session(t: DataFrame) -> DataFrame:
    return t.groupBy("namespace", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n")).select("namespace", "w.start", "n")


@query("namespace_counts", "v_log", sql="SELECT namespace, count(*) AS calls, count(*) FILTER (ok) AS hits FROM v_log GROUP BY namespace")
def namespace_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("namespace").agg(F.count("*").alias("calls"), F.count_if("ok").alias("hits"))


@query("cache_lookup", "v_log", sql="WITH c AS (SELECT DISTINCT namespace, props FROM v_log WHERE event_id % 4 = 0 AND NOT ok) SELECT event_id, c.props IS NULL AS miss FROM v_log l LEFT JOIN c ON l.namespace = c.namespace AND l.props = c.props")
def cache_lookup(t: DataFrame) -> DataFrame:
    cache = t.where("event_id % 4 = 0 and not ok").select("namespace", "props").distinct().withColumn("hit", F.lit(True))
    return t.join(cache, ["namespace", "props"], "left").select("event_id", F.col("hit").isNull().alias("miss"))
