"""Live figures of an arm's results: the median of its latest latencies and its failure streak.

A result counts in the order of its time and id, however it arrives: it waits in the
arm's state until the watermark has passed it, and then changes the arm's latest
latencies and its streak. Every result gives one row when its turn comes. A timer
wakes an arm when its first waiting result is due, so an arm needs no new input to
go on. An arm that was silent for longer than ``silent_ms`` between two results begins
anew; when none waits, another timer drops its state by then.

State is an arm's waiting results (as many as lie within the lateness), its ``size``
latest latencies and its streak. The results of a trigger wait in blocks along their time, as
bytes: a trigger writes its own and reads those that begin before the watermark, so a result
is written and read about once, however many triggers it waits for. Results later than the watermark are dropped, as
everywhere in streams. Null latencies leave the latest ones as they are; null outcomes
are no failures. Results with a null time never come to be due and are left out.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Latencies that the median is taken of, failures that trip the breaker.
LATEST, MOST_FAILURES = 200, 8
#: Waiting results of a block of state, and of what is sorted and given out at once, about.
BLOCK, PORTION = 8_192, 65_536
RESULT = np.dtype([("at", "<i8"), ("id", "<i8"), ("latency", "<f8"), ("failed", "?")])
FIGURES = "arm string, id long, p50 double, streak long, tripped boolean"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LiveFigures(StatefulProcessor):
    """One arm: waiting results, latest latencies, streak."""

    def __init__(self, size: int, most: int, silent_ms: int) -> None:
        self.size, self.most, self.silent_ms = size, most, silent_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, number long", "results binary")
        self.latest = handle.getListState("latest", "latency double")
        self.streak = handle.getValueState("streak", "streak long, last_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            new.append(np.empty(len(frame), RESULT))
            new[-1]["at"], new[-1]["id"] = frame["at_us"].astype("int64"), frame["id"].astype("int64")
            new[-1]["latency"], new[-1]["failed"] = frame["latency"].astype("float64"), frame["failed"].eq(True)  # no latency is NaN
        yield from self._advance(key, np.concatenate(new) if new else np.empty(0, RESULT), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, np.empty(0, RESULT), timerValues)

    def _due(self, new: np.ndarray, passed: int) -> Iterator[np.ndarray]:
        """Results up to ``passed`` in order, in portions; the others wait. Blocks are read as their
        time comes, and what lies before the next one's first is given out."""
        blocks = sorted(tuple(k) for k in self.waiting.keys()) if self.waiting.exists() else []
        number = max((n for _, n in blocks), default=-1) + 1
        here, new = {}, _sorted(new)
        for i in range(0, len(new), BLOCK):
            here[(int(new["at"][i]), number + i // BLOCK)] = new[i : i + BLOCK]
        self.firsts = [*(k[0] for k in blocks), *(k[0] for k in here)]
        queue, held = sorted(k for k in [*blocks, *here] if k[0] <= passed), np.empty(0, RESULT)
        for i, k in enumerate(queue):
            if k in here:
                found = here.pop(k)
            else:
                found = np.frombuffer(bytes(self.waiting.getValue(k)[0]), RESULT)
                self.waiting.removeKey(k)
            self.firsts.remove(k[0])
            held, last = np.concatenate([held, found]), i + 1 == len(queue)
            if last or len(held) >= PORTION:
                held = _sorted(held)
                n = int(np.searchsorted(held["at"], passed if last else queue[i + 1][0] - 1, "right"))
                yield held[:n]
                held = held[n:]
        number += -(-len(new) // BLOCK)
        for i in range(0, len(held), BLOCK):
            here[(int(held["at"][i]), number + i // BLOCK)] = held[i : i + BLOCK]
            self.firsts.append(int(held["at"][i]))
        for k, found in here.items():
            self.waiting.updateValue(k, (found.tobytes(),))

    def _advance(self, key, new: np.ndarray, timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1_000
        streak, last = tuple(self.streak.get()) if self.streak.exists() else (0, 0)
        recent = deque((r[0] for r in self.latest.get()), self.size) if self.latest.exists() else deque((), self.size)
        ordered, n = sorted(recent), 0
        for due in self._due(new, passed):
            out, n = [], n + len(due)
            for at, i, latency, failed in due.tolist():
                if at - last > self.silent_ms * 1_000:
                    recent.clear()
                    ordered, streak = [], 0
                streak, last = streak + 1 if failed else 0, at
                if latency == latency:
                    if len(recent) == self.size:
                        ordered.pop(bisect.bisect_left(ordered, recent[0]))
                    recent.append(latency)
                    bisect.insort(ordered, latency)
                middle = ordered[(len(ordered) + 1) // 2 - 1] if ordered else None
                out.append((key[0], i, middle, streak, streak >= self.most))
            yield pd.DataFrame(out, columns=["arm", "id", "p50", "streak", "tripped"])
        if n:
            self.streak.update((streak, last))
            if recent:
                self.latest.put([(x,) for x in recent])
            elif self.latest.exists():
                self.latest.clear()
        else:
            yield pd.DataFrame([], columns=["arm", "id", "p50", "streak", "tripped"])
        if self.firsts:
            self.handle.registerTimer(max(-(-min(self.firsts) // 1_000), passed // 1_000 + 1))
        elif last + self.silent_ms * 1_000 < passed:
            self.latest.clear()
            self.streak.clear()
        else:
            self.handle.registerTimer(last // 1_000 + self.silent_ms + 1)


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["id"], rows["at"]))]


def figures(results: DataFrame, lateness: str, size: int = LATEST, most: int = MOST_FAILURES, silent_ms: int = 86_400_000) -> DataFrame:
    """FIGURES of a stream of results (arm, id, at, latency, failed), one row each in its
    arm's order. Start it where ROCKS is set: its state is kept in that store."""
    rows = results.where(F.col("at").isNotNull()).select(F.col("arm").cast("string").alias("arm"), F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"),
                                                        F.col("latency").cast("double").alias("latency"), F.col("failed").cast("boolean").alias("failed"))
    return rows.withWatermark("at", lateness).groupBy("arm").transformWithStateInPandas(LiveFigures(size, most, silent_ms), FIGURES, "Append", "EventTime")


def write_figures(stream: DataFrame, folder: str):
    """Runs a stream of ``figures`` over what there is; rows go to ``folder``/rows."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:  # the query keeps the settings that it begins with
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/rows")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(FIGURES).parquet(f"{folder}/rows")
