"""Grouped, cubed and sliced accuracy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.stats import safe_rate, wilson, wilson_clamped
from ruleloom.operators.rules import flags


def counters(choice: Column, valid: Column, expected: Column, abstain: Column, ambiguous: Column) -> list[Column]:
    """The counters of an outcome table, each of a row's flags; nothing is ever null."""
    abstained, correct = flags(choice, valid, expected, abstain)
    valid, want = F.coalesce(valid, F.lit(False)), F.coalesce(expected == abstain, F.lit(False))
    named = {"n": F.lit(True), "n_ambiguous": F.coalesce(ambiguous, F.lit(False)), "valid": valid, "invalid": ~valid, "correct": correct, "wrong": ~correct, "wrong_valid": valid & ~correct, "no_choice": choice.isNull(),
             "abstained": abstained, "abstain_expected": want, "abstain_right": want & abstained, "abstain_missed": want & valid & ~abstained, "over_abstained": ~want & abstained, "answered": valid & ~abstained, "answered_right": correct & ~abstained}
    return [F.count_if(v).alias(k) for k, v in named.items()]


def by_stratum(rows: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    """Accuracy of each group with the unclamped Wilson interval."""
    agg = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(correct).alias("correct"))
    p, lo, hi = wilson(F.col("correct"), F.col("n"))
    return agg.select(*keys, "n", "correct", F.round(p, 6).alias("rate"), F.round(lo, 6).alias("ci_low"), F.round(hi, 6).alias("ci_high"))


def cube(rows: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    """Accuracy over every subset of ``keys``; a key that is summed over reads
    ALL. One expand and one shuffle, partial sums first."""
    agg = rows.cube(*keys).agg(F.count("*").alias("n"), F.count_if(correct).alias("correct"), *(F.grouping(k).alias(f"g_{k}") for k in keys))
    p, lo, hi = wilson_clamped(F.col("correct"), F.col("n"))
    named = [F.when(F.col(f"g_{k}") == 1, "ALL").otherwise(F.col(k)).alias(k) for k in keys]
    return agg.select(*named, "n", "correct", F.round(p, 6).alias("rate"), F.round(lo, 6).alias("ci_low"), F.round(hi, 6).alias("ci_high"))


def scopes(rows: DataFrame, outer: str, inner: str, correct: Column) -> DataFrame:
    """The two scopes (outer) and (outer, inner) in one pass."""
    agg = rows.groupingSets([[F.col(outer)], [F.col(outer), F.col(inner)]], F.col(outer), F.col(inner)).agg(
        F.count("*").alias("n"), F.count_if(correct).alias("correct"), F.grouping(inner).alias("g"))
    return agg.select(F.when(F.col("g") == 1, outer).otherwise(f"{outer}+{inner}").alias("scope"), outer, F.when(F.col("g") == 0, F.col(inner)).alias(inner),
                      "n", "correct", F.round(safe_rate(F.col("correct"), F.col("n")), 6).alias("rate"))


def factor_slices(rows: DataFrame, factors: dict[str, Column], correct: Column) -> DataFrame:
    """Accuracy by each value of each factor: factors become rows inside the
    task, so the scan is read once however many factors there are."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("factor"), c.cast("string").alias("value")) for k, c in factors.items()))).alias("f")
    sliced = rows.select(correct.alias("ok"), pairs).select("ok", "f.factor", "f.value")
    agg = sliced.groupBy("factor", "value").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"))
    return agg.withColumn("rate", F.round(safe_rate(F.col("correct"), F.col("n")), 6))


def abstention(rows: DataFrame, keys: list[str], abstained: Column, expected: Column) -> DataFrame:
    """How often abstaining was right, and how often it was not called for."""
    agg = rows.groupBy(*keys).agg(
        F.count_if(expected).alias("n_expected"), F.count_if(expected & abstained).alias("n_abstained_right"),
        F.count_if(~expected).alias("n_answerable"), F.count_if(~expected & abstained).alias("n_over_abstained"))
    right, over = wilson(F.col("n_abstained_right"), F.col("n_expected")), wilson(F.col("n_over_abstained"), F.col("n_answerable"))
    return agg.select("*", F.round(right[0], 6).alias("abstain_rate"), F.round(right[1], 6).alias("abstain_low"), F.round(over[0], 6).alias("over_rate"), F.round(over[2], 6).alias("over_high"))
