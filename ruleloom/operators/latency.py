"""Latency, throughput, streaks and cost over attempt logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.operators.percentiles import percentiles
from ruleloom.operators.sampling import carried


def summary(rows: DataFrame, keys: list[str], value: str, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean, nearest-rank percentiles, least and most of each group, whatever its size."""
    facts = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    each = percentiles(rows, keys, value, list(qs)).groupBy(*(F.col(k).alias(f"of_{k}") for k in keys)).agg(*(F.max(F.when(F.col("q") == q, F.col("at"))).alias(f"p{round(q * 100)}") for q in qs))
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    return facts.join(each, met, "left").select(*keys, "n", "mean", *(f"p{round(q * 100)}" for q in qs), "least", "most")


def throughput(rows: DataFrame, phase: str, segment: str, at: str, valid: Column) -> DataFrame:
    """Valid results a minute: spans are summed over segments, so that pauses
    between segments don't count."""
    spans = rows.groupBy(phase, segment).agg(F.count_if(valid).alias("n"), (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))).alias("span"))
    agg = spans.groupBy(phase).agg(F.sum("n").alias("n_valid"), F.count("*").alias("segments"), F.sum("span").alias("span"))
    return agg.select(phase, "n_valid", "segments", F.round(F.try_divide(F.col("n_valid") * 60e6, F.col("span")), 6).alias("per_minute"))


def overlaps(rows: DataFrame, segment: str, order: list[str], begin: str, end: str, tolerance: float, bucket: Column) -> DataFrame:
    """Rows that begin before the latest end so far in their segment, by more than
    the tolerance. ``bucket`` parts a segment along ``order``."""
    seen = carried(rows, [segment], order, bucket, "max", F.col(end), "latest")
    return seen.where(F.col(begin) < F.col("latest") - tolerance).drop("latest")


def streaks(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Runs of failures without a success between: start, length."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = rows.select(key, *order, failed.alias("failed")).withColumn("run", F.sum((~F.col("failed")).cast("long")).over(w))
    return runs.where("failed").groupBy(key, "run").agg(F.min(order[-1]).alias("first_id"), F.count("*").alias("length")).drop("run")


def recent(rows: DataFrame, key: str, order: list[str], value: str, size: int) -> Column:
    """The median (nearest rank) of the last ``size`` values up to a row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(size - 1), 0)
    last = F.array_sort(F.collect_list(value).over(w))
    return F.element_at(last, F.ceil(F.size(last) * 0.5).cast("int"))


def nano_usd(usd: Column) -> Column:
    """Whole nano dollars, rounded up."""
    return F.ceil(usd * 1e9 - 1e-6)


def cost(attempts: DataFrame, trial: list[str], group: str, known: Column, reported: str, reserved: str) -> DataFrame:
    """Attempts to trials to groups; an unknown cost is charged as reserved."""
    each = attempts.groupBy(group, *trial).agg(F.sum(F.when(known, F.col(reported)).otherwise(F.col(reserved))).alias("charged"), F.count_if(~known).alias("unknown"), F.count("*").alias("attempts"))
    return each.groupBy(group).agg(F.count("*").alias("trials"), F.sum("attempts").alias("attempts"), F.sum("unknown").alias("unknown"), F.round(F.sum("charged"), 4).alias("charged"))
