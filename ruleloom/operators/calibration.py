"""Calibration: thresholds, bins, and confidence when right and wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.stats import safe_rate
from ruleloom.functions.text import bound


def selective(rows: DataFrame, keys: list[str], score: Column, correct: Column, thresholds: list[float]) -> DataFrame:
    """Coverage and accuracy at each threshold. Coverage is over all rows. A row
    is counted under the last threshold that it reaches, and counts are summed
    downward over the few thresholds: rows aren't multiplied."""
    steps = sorted(thresholds)
    reached = F.array_max(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= score))
    counted = rows.select(*keys, F.coalesce(reached, F.lit(-1.0)).alias("reached"), correct.alias("ok")).groupBy(*keys, "reached").agg(F.count("*").alias("n"), F.count_if("ok").alias("c"))
    spread = counted.select("*", F.explode(F.array(*map(F.lit, steps))).alias("threshold"))
    inside = F.col("reached") >= F.col("threshold")
    agg = spread.groupBy(*keys, "threshold").agg(F.sum("n").alias("n"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("covered"), F.sum(F.when(inside, F.col("c")).otherwise(0)).alias("correct"))
    return agg.select("*", F.round(safe_rate(F.col("covered"), F.col("n")), 6).alias("coverage"), F.round(safe_rate(F.col("correct"), F.col("covered")), 6).alias("accuracy"))


def reliability(rows: DataFrame, keys: list[str], score: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Per bin of equal width: n, mean score, accuracy."""
    b = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def ece(rows: DataFrame, keys: list[str], score: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width."""
    r = reliability(rows, keys, score, correct, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")
    return r.groupBy(*keys).agg(F.sum("n").alias("n"), F.round(gap, 6).alias("ece"))


def confidence_split(rows: DataFrame, keys: list[str], score: Column, correct: Column, sure: float = 0.9) -> DataFrame:
    """Mean score of right and of wrong answers, and wrong ones that were sure."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.when(correct, score)), 6).alias("right_mean"), F.round(F.avg(F.when(~correct, score)), 6).alias("wrong_mean"),
                                   F.count_if(~correct & (score >= sure)).alias("overconfident"))


def softmax(values: Column, scale: float) -> Column:
    """Numerically safe softmax of an array; its largest and its sum are worked out once."""
    powers = bound(F.struct(values.alias("v"), F.array_max(values).alias("top")), lambda s: F.transform(s["v"], lambda x: F.exp((x - s["top"]) * scale)))
    return bound(powers, lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))
