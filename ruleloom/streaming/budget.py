"""Budgets and roll-ups over streams of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows that a task gives out at once, and what stands for an unknown cost.
AT_ONCE, UNKNOWN = 10_000, -(1 << 63)
SPEND = "budget string, attempt_id long, admitted boolean, spent_nano long"


def admit(attempts: DataFrame, cap_nano: int) -> DataFrame:
    """(budget, attempt_id, admitted, spent_nano): attempts reserve before they
    run and settle to what they cost; an unknown cost keeps its reservation. An
    attempt is admitted while spend and its reservation stay within the cap.

    ``attempts``: budget, attempt_id, reserved_nano, cost_nano (null: unknown).
    State is one number for each budget; budgets are independent keys. A task keeps 24
    bytes for each attempt of a budget in a trigger while it puts them in order, and
    gives out its rows in parts."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (spent,) = state.get if state.exists else (0,)
        parts: list[list[np.ndarray]] = [[], [], []]
        for pdf in batches:  # of a batch its numbers alone are kept
            for part, values in zip(parts, (pdf["attempt_id"], pdf["reserved_nano"], pdf["cost_nano"].fillna(UNKNOWN))):
                part.append(values.to_numpy(np.int64, copy=True))
        ids, reserved, costs = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(order), AT_ONCE):
            some = order[at:at + AT_ONCE]
            admitted, spends = [], []
            for r, cost in zip(reserved[some].tolist(), costs[some].tolist()):
                ok = spent + r <= cap_nano
                if ok:
                    spent += r if cost == UNKNOWN else cost
                admitted.append(ok)
                spends.append(spent)
            if at + AT_ONCE >= len(order):
                state.update((spent,))
            yield pd.DataFrame({"budget": key[0], "attempt_id": ids[some], "admitted": admitted, "spent_nano": spends})

    return attempts.groupBy("budget").applyInPandasWithState(run, SPEND, "spent long", "append", GroupStateTimeout.NoTimeout)


def status(attempts: DataFrame, at: str, every: str, lateness: str) -> DataFrame:
    """A roll-up for each window: attempts, failures and the median latency; late
    rows are dropped beyond the watermark."""
    w = F.window(at, every)
    agg = attempts.withWatermark(at, lateness).groupBy(w).agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failures"), F.percentile_approx("value", 0.5).alias("p50"))
    return agg.select(F.col("window.start").alias("start"), "attempts", "failures", "p50")


def unseen(trials: DataFrame, at: str, lateness: str) -> DataFrame:
    """Trials not completed before: a resumed run skips what it has done."""
    return trials.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["trial_id"])


def drifted(results: DataFrame, pinned: list[str]) -> DataFrame:
    """Results of a model outside the pinned set."""
    return results.where(~F.col("api_model").isin(pinned) | F.col("api_model").isNull())
