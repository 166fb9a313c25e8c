"""Budgets: which attempts of a log are admitted under a cap, and what they spend.

An attempt reserves before it runs and settles to what it cost; an unknown cost
keeps its reservation. It is admitted while spend and its reservation stay within
the cap. What is spent so depends on every earlier decision of its budget, and a
budget may have any number of attempts, so this is a fold by ``scan.folded``.

The sum of all earlier charges is the most that can be spent before a bucket. Where
all of a bucket would fit even so, nothing is refused in it and only its sum counts.
Once something was refused, spend is within the largest reservation of the cap: the
functions of all later buckets are worked out for that last stretch alone, and that
of the bucket which may first refuse from its sum on.

Attempts with null budgets are a budget of their own; a null or negative reservation
or a negative cost is an error, as spend could fall. Ids in one budget that are
repeated are decided one by one, in no order among themselves. Empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.operators.scan import Steps, folded

#: Attempts of a bucket, about.
BUCKET = 2_048
DECISIONS = "budget string, attempt_id long, admitted boolean, spent_nano long"


def _bucketed(attempts: DataFrame) -> DataFrame:
    """Attempts with bucket: ranges of ids that hold about BUCKET attempts of a budget
    if ids are dealt evenly; splitting the ids once more where they aren't would
    change nothing but the size of a task."""
    facts = attempts.groupBy("budget").agg(F.min("attempt_id").alias("least"), F.max("attempt_id").alias("most"), F.count("*").alias("n"), F.max("reserved_nano").alias("largest"))
    width = F.greatest(F.lit(1), F.ceil((F.col("most") - F.col("least") + 1) / F.ceil(F.col("n") / BUCKET)))
    met = attempts.join(facts.select(F.col("budget").alias("of_budget"), "least", "largest", width.cast("long").alias("width")), F.col("budget").eqNullSafe(F.col("of_budget"))).drop("of_budget")
    return met.withColumn("bucket", F.expr("(attempt_id - least) div width")).drop("least", "width")


def _checked(attempts: DataFrame) -> DataFrame:
    wrong = F.col("reserved_nano").isNull() | (F.col("reserved_nano") < 0) | (F.col("cost_nano") < 0)
    told = F.when(wrong, F.raise_error(F.lit("reservations and costs must not be null or negative")).cast("long")).otherwise(F.col("reserved_nano").cast("long"))
    return attempts.select(F.col("budget").cast("string").alias("budget"), F.col("attempt_id").cast("long").alias("attempt_id"), told.alias("reserved_nano"), F.col("cost_nano").cast("long").alias("cost_nano"))


def admitted(attempts: DataFrame, cap_nano: int, log: DataFrame | None = None) -> DataFrame:
    """DECISIONS on ``attempts`` (budget, attempt_id, reserved_nano, cost_nano) in the
    order of their ids. ``log`` has decisions of an earlier run: its attempts are not
    decided again, and its spend is what each budget begins with."""
    rows, begin = _checked(attempts), None
    if log is not None:
        rows = unfinished(rows, log)
        begin = spend(log).select(F.coalesce("budget", F.lit("")).alias("key"), F.col("budget").isNull().alias("none"), F.col("spent_nano").alias("state"))
    charged = F.coalesce("cost_nano", "reserved_nano")
    dealt = _bucketed(rows).withColumn("key", F.coalesce("budget", F.lit(""))).withColumn("none", F.col("budget").isNull())
    keys = ["key", "none"]
    sums = dealt.groupBy(*keys, "bucket").agg(F.sum(charged).alias("here"))
    if begin is not None:
        sums = sums.join(begin, keys, "left")
    else:
        sums = sums.withColumn("state", F.lit(0))
    before = F.coalesce(F.sum("here").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("state", F.lit(0))
    dealt = dealt.join(sums.select(*keys, "bucket", before.alias("before")), [*keys, "bucket"])

    def charges(frame: pd.DataFrame) -> np.ndarray:
        return np.where(frame["cost_nano"].isna(), frame["reserved_nano"], frame["cost_nano"]).astype(np.int64)

    def bound(frame: pd.DataFrame) -> tuple[bool, int]:
        """Whether a bucket admits all, and the state from which its steps are to be known."""
        before, reserved, cost = int(frame["before"].iloc[0]), frame["reserved_nano"].to_numpy(np.int64), charges(frame)
        if before + int((np.cumsum(cost) - cost + reserved).max()) <= cap_nano:
            return True, before + 1
        return False, min(before, cap_nano - int(frame["largest"].iloc[0]))

    def each(frame: pd.DataFrame) -> Iterator[Steps]:
        whole, low = bound(frame)
        if whole:
            yield Steps([low], [1], [0], [0])  # never entered
            return
        for limit, c in zip((cap_nano - frame["reserved_nano"].to_numpy(np.int64)).tolist(), charges(frame).tolist()):
            # up to the limit it is admitted and charged, above it refused
            yield Steps([low], [1], [0], [0]) if limit < low else Steps([low, limit + 1], [1, 1], [c, 0], [1, 0])

    def below(frame: pd.DataFrame) -> tuple[int, int, int]:
        return bound(frame)[1], int(charges(frame).sum()), len(frame)

    def take(frame: pd.DataFrame, state: int, count: int) -> tuple[list, list]:
        ok, spent = [], []
        for reserved, cost in zip(frame["reserved_nano"].tolist(), frame["cost_nano"].tolist()):
            fits = state + reserved <= cap_nano
            if fits:
                state += int(reserved) if cost is None or cost != cost else int(cost)
            ok.append(fits)
            spent.append(state)
        return ok, spent

    decided = folded(dealt, keys, ["attempt_id"], "bucket", each, take, "admitted boolean, spent_nano long", begin, below)
    return decided.select("budget", "attempt_id", "admitted", "spent_nano")


def spend(log: DataFrame) -> DataFrame:
    """(budget, spent_nano): what a log says is spent; spend never falls."""
    return log.groupBy("budget").agg(F.max("spent_nano").alias("spent_nano"))


def unfinished(attempts: DataFrame, log: DataFrame) -> DataFrame:
    """Attempts that a log has no decision on."""
    done = log.select(F.col("budget").alias("of_budget"), F.col("attempt_id").alias("done_id")).distinct()
    return attempts.join(done, F.col("budget").eqNullSafe(F.col("of_budget")) & (F.col("attempt_id") == F.col("done_id")), "left_anti")


def stream_admitted(attempts: DataFrame, cap_nano: int, folder: str, checkpoint: str, **trigger):
    """A stream of attempts decided trigger by trigger, each by ``admitted``; the query.

    Decisions go to ``folder``/rows, spend to ``folder``/spend, one folder for each trigger: a
    trigger that is run again after a loss overwrites its own. A restarted query goes
    on from the last trigger's spend, so restoring reads one row for each budget. Order
    holds by id within a trigger and by trigger: what comes later is decided later."""
    rows, totals = f"{folder}/rows", f"{folder}/spend"

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        begun = None
        if number:
            begun = spark.read.schema("budget string, spent_nano long").parquet(f"{totals}/trigger={number - 1}").withColumn("attempt_id", F.lit(None).cast("long"))
        admitted(batch, cap_nano, begun).write.mode("overwrite").parquet(f"{rows}/trigger={number}")
        now = spend(spark.read.schema(DECISIONS).parquet(f"{rows}/trigger={number}"))
        if begun is not None:
            now = spend(now.unionByName(begun.select("budget", "spent_nano")))
        now.write.mode("overwrite").parquet(f"{totals}/trigger={number}")

    return attempts.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
