"""A query over a stream of results, in several triggers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ruleloom.sources.shared import shared_dir
from ruleloom.sources.tables import table
from ruleloom.streaming import live

ARMS, PARTS, SIZE, MOST = 20, 4, 50, 3
#: At most so many triggers, however many files the input has: each begins all its tasks anew.
TRIGGERS = 8


def live_figures(spark, sf_dir):
    """The events as results of some arms, streamed part by part: each one's median of
    latest values and failure streak when its turn came. A last result, of no arm, a month
    later lets all others become due."""
    results = table(spark, sf_dir, "events").select((F.col("user_id") % ARMS).cast("string").alias("arm"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"),
                                                    F.when(F.col("event_type") != "error", F.col("value")).alias("latency"), (F.col("event_type") == "error").alias("failed"))
    folder = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    span = results.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if span["first"] is None:
        return spark.createDataFrame([], live.FIGURES)
    step = (span["last"] - span["first"]) / PARTS
    for k in range(PARTS):  # one after the other, so that a stream meets them in about this order
        here = (F.col("at") >= F.lit(span["first"] + k * step)) & (F.col("at") < F.lit(span["first"] + (k + 1) * step) if k < PARTS - 1 else F.lit(True))
        results.where(here).write.mode("append").parquet(f"{folder}/in")
    end = results.agg(F.lit("none").alias("arm"), F.lit(-1).cast("long").alias("id"), (F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("at"), F.lit(None).cast("double").alias("latency"), F.lit(False).alias("failed"))
    end.write.mode("append").parquet(f"{folder}/in")
    files = len(spark.read.schema(results.schema).parquet(f"{folder}/in").inputFiles())
    stream = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", max(8, -(-files // TRIGGERS))).parquet(f"{folder}/in")
    done = live.write_figures(live.figures(stream, f"{int(step.total_seconds()) * 2} seconds", SIZE, MOST, silent_ms=10**11), folder)
    return done.where("id >= 0").select("arm", "id", "p50", "streak", "tripped")


QUERIES = {"live_figures": live_figures}

ORACLE_SQL = {
    "live_figures": f"""
        WITH e AS (SELECT (user_id % {ARMS})::VARCHAR AS arm, event_id AS id, ts, CASE WHEN event_type <> 'error' THEN value END AS latency, event_type = 'error' AS failed FROM events),
        m AS (SELECT id, quantile_disc(latency, 0.5) OVER (PARTITION BY arm ORDER BY ts, id ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW) AS p50 FROM e WHERE latency IS NOT NULL),
        r AS (SELECT e.*, m.p50 AS own, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY arm ORDER BY ts, e.id) AS run FROM e LEFT JOIN m USING (id))
        SELECT arm, id, last_value(own IGNORE NULLS) OVER (PARTITION BY arm ORDER BY ts, id) AS p50, (count(*) FILTER (WHERE failed) OVER w)::BIGINT AS streak, count(*) FILTER (WHERE failed) OVER w >= {MOST} AS tripped
        FROM r WINDOW w AS (PARTITION BY arm, run ORDER BY ts, id)""",
}
