"""Integrity audits: violations as rows of one table of checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.text import span_agrees
from ruleloom.operators.sampling import carried

EXAMPLES = 25


def check(name: str, rows: DataFrame, key: str, bad: Column, hard: bool = True) -> DataFrame:
    """One row: how many were checked and failed, with the smallest EXAMPLES failing keys."""
    return catalogue(rows, key, [(name, bad, hard)])


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def catalogue(rows: DataFrame, key: str, checks: list[tuple[str, Column, bool]]) -> DataFrame:
    """(check, hard, n_checked, n_failed, examples): a row for each of ``checks``
    (name, bad, hard), all counted and their examples found in one pass. A null
    verdict is a failure; a null key is no example.

    ``rows`` are worked out once. A task passes on a row for each check: how many
    it saw, how many failed, and their EXAMPLES smallest keys."""
    bad = [F.coalesce(b, F.lit(True)).alias(f"b{i}") for i, (_, b, _) in enumerate(checks)]

    many = len(checks)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, failed, first = 0, [0] * many, [np.zeros(0, np.int64)] * many
        for pdf in batches:
            n += len(pdf)
            keys, known = pdf["key"].to_numpy(np.int64, na_value=0), pdf["key"].notna().to_numpy()
            for i in range(many):
                hit = pdf[f"b{i}"].to_numpy(bool)
                count = int(hit.sum())
                if count:
                    failed[i] += count
                    first[i] = np.sort(np.concatenate([first[i], keys[hit & known]]))[:EXAMPLES]
        yield pd.DataFrame({"i": range(many), "n": n, "failed": failed, "first": [x.tolist() for x in first]})

    told = rows.select(F.col(key).cast("long").alias("key"), *bad).mapInPandas(tally, "i int, n long, failed long, first array<long>")
    summed = told.groupBy("i").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.array_sort(F.flatten(F.collect_list("first"))).alias("first"))
    named = rows.sparkSession.createDataFrame([(i, name, hard) for i, (name, _, hard) in enumerate(checks)], "i int, check string, hard boolean")
    examples = F.concat_ws(",", F.slice("first", 1, EXAMPLES).cast("array<string>"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return named.join(summed, "i", "left").select("check", "hard", zero("n").alias("n_checked"), zero("failed").alias("n_failed"), examples.alias("examples"))


def result_checks(arms: list[str], local: str) -> list[tuple[str, Column, bool]]:
    """The checks of a result beside its planned trial, its case, its recomputed
    answer and its attempt lines. Columns: what was recorded by its own name;
    ``plan_``, ``bank_`` and ``re_`` before what it is held against. The arm
    ``local`` has no price."""
    c = F.col
    differ = lambda pairs: reduce(lambda a, b: a | b, [~c(a).eqNullSafe(c(b)) for a, b in pairs])
    planned, known = c("plan_trial").isNotNull(), c("bank_case").isNotNull() & c("arm").isin(arms)
    right = c("re_valid") & (c("re_choice") == c("bank_expected"))
    abstained = c("re_valid") & (c("re_choice") == c("bank_abstain"))
    same = lambda a, b: c(a).eqNullSafe(c(b))
    truth = lambda x: F.coalesce(x, F.lit(False))
    return [
        ("results reference planned trials", ~planned, True), ("result case/phase/rep match plan", planned & differ([("case_id", "plan_case"), ("phase", "plan_phase"), ("rep", "plan_rep")]), True),
        ("result arm is known", ~truth(c("arm").isin(arms)), True), ("results reference bank cases", truth(c("arm").isin(arms)) & c("bank_case").isNull(), True),
        ("result workflow/stratum match bank", known & differ([("workflow", "bank_workflow"), ("stratum", "bank_stratum")]), True), ("result input_hash matches recomputation", known & ~same("input_hash", "bank_hash"), True),
        ("result options equal bank options", known & ~same("options", "bank_options"), True), ("result expected equals bank label", known & ~same("expected", "bank_expected"), True),
        ("result validity matches re-validation", known & ~same("valid", "re_valid"), True), ("result choice matches raw answer", known & c("re_valid") & same("valid", "re_valid") & ~same("choice", "re_choice"), True),
        ("result correct matches recomputation", known & ~c("correct").eqNullSafe(truth(right)), True), ("result abstained matches recomputation", known & c("re_valid") & ~c("abstained").eqNullSafe(truth(abstained)), True),
        ("local cost recorded as unknown", known & (c("arm") == local) & (c("cost").isNotNull() | truth(c("cost_known"))), True), ("results.attempts equals attempt lines", known & ~same("attempts", "n_lines"), True),
        ("lenient choice matches recomputation", known & ~same("lenient", "re_lenient"), False), ("invalid results record no choice", known & ~c("re_valid") & c("choice").isNotNull(), False),
        ("invalid results carry failure_reason", known & ~c("re_valid") & (F.coalesce("failure_reason", F.lit("")) == ""), False),
        ("invalid result abstained flag", known & ~c("re_valid") & ~c("abstained").eqNullSafe(F.lit(False)), False),
        ("results.retries == attempts-1", known & same("attempts", "n_lines") & ~c("retries").eqNullSafe(c("n_lines") - 1), False)]


def attempt_checks(cap_usd: float, tolerance_ms: float, deadline: Column, grace_s: float) -> list[tuple[str, Column, bool]]:
    """The checks of an attempt line by itself: reservation, cost, timestamps, deadline.
    Columns: reserved_usd, cost_usd, cost_known, t_start, t_end, latency_ms, planned."""
    c = F.col
    late = F.unix_micros("t_start") > F.unix_micros(deadline) + F.lit(int(grace_s * 1e6))
    spoilt = c("t_start").isNull() | c("t_end").isNull() | (c("t_end") < c("t_start"))
    return [
        ("every attempt reserves more than nothing", ~F.coalesce((c("reserved_usd") > 0) & (c("reserved_usd") <= cap_usd), F.lit(False)), True),
        ("a known cost is finite and not negative", F.coalesce("cost_known", F.lit(False)) & ~F.coalesce((c("cost_usd") >= 0) & (c("cost_usd") < float("inf")), F.lit(False)), True),
        ("attempts reference planned trials", ~c("planned"), True), ("no attempt started after deadline", F.coalesce(late, F.lit(False)), True),
        ("attempt timestamps parse and end after start", spoilt, False), ("attempt latency equals its span", c("t_start").isNotNull() & c("t_end").isNotNull() & ~span_agrees(c("latency_ms"), c("t_start"), c("t_end"), tolerance_ms), False)]


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str, bucket: Column | None = None) -> DataFrame:
    """Each row with the value of the latest mark at or before it, by key; of marks of
    one time the largest value. Null keys meet null keys; rows and marks without a
    time meet none.

    Rows and marks are sorted together, so no row meets more than one mark.
    ``bucket`` (of ``at``, growing with it) parts a key along time: a task sorts a bucket, and
    the last mark is carried from bucket to bucket, so a hot key is many tasks."""
    kind = marks.schema[value].dataType
    noted = marks.where(F.col(at).isNotNull()).select(key, at, F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("mark"), F.lit(0).alias("is_row"))
    both = rows.withColumn("mark", F.lit(None).cast(noted.schema["mark"].dataType)).withColumn("is_row", F.lit(1)).unionByName(noted, allowMissingColumns=True)
    seen = carried(both, [key], [at, "is_row"], F.lit(0) if bucket is None else bucket, "max", F.col("mark"), "latest").where("is_row = 1")
    return seen.select(*rows.columns, F.when(F.col(at).isNotNull(), F.col("latest.v")).cast(kind).alias(value))
