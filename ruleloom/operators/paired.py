"""Paired comparisons of two outcomes, repeats and counterfactual siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.stats import mcnemar_exact, safe_rate


def contingency(rows: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Both right, only the first, only the second, neither; with the exact McNemar p."""
    agg = rows.groupBy(*keys).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))
    return agg.withColumn("p_value", F.round(mcnemar_exact(F.col("only_a"), F.col("only_b")), 6))


def stability(rows: DataFrame, case: str, choice: Column) -> DataFrame:
    """Per case, its trials and different choices; an invalid one is a choice of its own."""
    return rows.groupBy(case).agg(F.count("*").alias("trials"), F.count_distinct(F.coalesce(choice, F.lit("<invalid>"))).alias("choices"))


def best_trial(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of each group that is first by ``order``: a minimum, not a sort."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in keep))


def flips(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(expected_base, expected, choice_base, choice): how often choices change when
    labels do, and stay when they stay."""
    changed, moved = F.col("expected") != F.col("expected_base"), ~F.col("choice").eqNullSafe(F.col("choice_base"))
    agg = pairs.groupBy(*keys).agg(F.count_if(changed).alias("n_flip"), F.count_if(changed & moved).alias("flipped"), F.count_if(~changed).alias("n_same"), F.count_if(~changed & ~moved).alias("stayed"))
    return agg.select("*", F.round(safe_rate(F.col("flipped"), F.col("n_flip")), 6).alias("sensitivity"), F.round(safe_rate(F.col("stayed"), F.col("n_same")), 6).alias("invariance"))
