"""Attempt-log queries: events play attempts, users trials, days segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.operators import latency as L
from ruleloom.sources.tables import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.to_date("ts").alias("segment"))


def latency_percentiles(spark, sf_dir):
    return L.summary(_events(spark, sf_dir), ["event_type"], "value")


def throughput_by_segment(spark, sf_dir):
    return L.throughput(_events(spark, sf_dir), "event_type", "segment", "ts", F.col("value") > 1)


def failure_histogram(spark, sf_dir):
    reason = F.coalesce(F.when(F.col("event_type") == "error", F.concat(F.lit("api:"), F.floor("value").cast("string"))).when(F.col("event_type") == "view", "malformed"), F.lit("unknown"))
    rows = _events(spark, sf_dir).where(F.col("event_type") != "purchase")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def running_max_violations(spark, sf_dir):
    rows = _events(spark, sf_dir).select("segment", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("begin"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1e6)).alias("end"))
    return L.overlaps(rows, "segment", ["event_id"], "begin", "end", 1_000_000, F.expr("event_id div 4096")).select("event_id", F.col("begin").alias("begin_us"))


def failure_streaks(spark, sf_dir):
    return L.streaks(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


def breaker_trips(spark, sf_dir):
    """Users whose failures ran on for two attempts and more, and how often."""
    s = L.streaks(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return s.where("length >= 2").groupBy("user_id").agg(F.count("*").alias("trips"), F.max("length").alias("longest"))


def recent_latency(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return rows.select("event_id", L.recent(rows, "user_id", ["ts", "event_id"], "value", 20).alias("recent_p50"))


def retry_attempts(spark, sf_dir):
    """Attempts of each trial (user and day): number, retries, first and last outcome."""
    agg = _events(spark, sf_dir).groupBy("user_id", "segment").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failures"),
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return agg.select("user_id", F.col("segment").cast("string").alias("segment"), "attempts", (F.col("attempts") - 1).alias("retries"), "failures", "first", "last")


def cost_rollup(spark, sf_dir):
    return L.cost(_events(spark, sf_dir).withColumn("reserved", F.lit(2.0)), ["user_id", "segment"], "event_type", F.col("event_id") % 4 != 0, "value", "reserved")


def nano_cost(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.sum(L.nano_usd(F.col("event_id") * 1e-9)).cast("long").alias("nano"))


QUERIES = {f.__name__: f for f in (latency_percentiles, throughput_by_segment, failure_histogram, running_max_violations, failure_streaks, breaker_trips, recent_latency, retry_attempts, cost_rollup, nano_cost)}

_E = "SELECT event_id, ts, user_id, event_type, value, ts::DATE AS segment FROM events"
_STREAKS = f"""
    SELECT user_id, min(event_id) AS first_id, count(*)::BIGINT AS length FROM (
      SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) WHERE event_type = 'error' GROUP BY user_id, run"""
ORACLE_SQL = {
    "latency_percentiles": """
        SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5)::DOUBLE AS p50, quantile_disc(value, 0.95)::DOUBLE AS p95,
          quantile_disc(value, 0.99)::DOUBLE AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY 1""",
    "throughput_by_segment": f"""
        WITH s AS (SELECT event_type, segment, count(*) FILTER (WHERE value > 1) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM ({_E}) GROUP BY 1, 2)
        SELECT event_type, sum(n)::BIGINT AS n_valid, count(*)::BIGINT AS segments, round(sum(n)::DOUBLE * 60e6 / nullif(sum(span), 0)::DOUBLE, 6) AS per_minute FROM s GROUP BY 1""",
    "failure_histogram": """
        SELECT CASE event_type WHEN 'error' THEN 'api:' || floor(value)::BIGINT::VARCHAR WHEN 'view' THEN 'malformed' ELSE 'unknown' END AS reason, count(*)::BIGINT AS n
        FROM events WHERE event_type <> 'purchase' GROUP BY 1""",
    "running_max_violations": f"""
        WITH t AS (SELECT segment, event_id, epoch_us(ts) AS begin_us, epoch_us(ts) + floor(value * 1e6)::BIGINT AS e FROM ({_E})),
        m AS (SELECT *, max(e) OVER (PARTITION BY segment ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM t)
        SELECT event_id, begin_us FROM m WHERE begin_us < latest - 1000000""",
    "failure_streaks": _STREAKS,
    "breaker_trips": f"SELECT user_id, count(*)::BIGINT AS trips, max(length)::BIGINT AS longest FROM ({_STREAKS}) WHERE length >= 2 GROUP BY 1",
    "recent_latency": """
        SELECT event_id, quantile_disc(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)::DOUBLE AS recent_p50 FROM events""",
    "retry_attempts": f"""
        SELECT user_id, segment::VARCHAR AS segment, count(*)::BIGINT AS attempts, (count(*) - 1)::BIGINT AS retries, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failures,
          arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM ({_E}) GROUP BY 1, segment""",
    "cost_rollup": f"""
        WITH t AS (SELECT event_type, user_id, segment, sum(CASE WHEN event_id % 4 <> 0 THEN value ELSE 2.0 END) AS charged, count(*) FILTER (WHERE event_id % 4 = 0) AS unknown, count(*) AS attempts FROM ({_E}) GROUP BY 1, 2, 3)
        SELECT event_type, count(*)::BIGINT AS trials, sum(attempts)::BIGINT AS attempts, sum(unknown)::BIGINT AS unknown, round(sum(charged), 4)::DOUBLE AS charged FROM t GROUP BY 1""",
    "nano_cost": "SELECT event_type, sum(ceil(event_id::DOUBLE * 1e-9 * 1e9 - 1e-6))::BIGINT AS nano FROM events GROUP BY 1",
}
