"""Live figures of a stream in several triggers against the answer over all rows."""

import datetime as dt

import numpy as np

from ruleloom.streaming import live

RESULT = "arm string, id long, at timestamp, latency double, failed boolean"
BASE = dt.datetime(2024, 1, 1)


def plain(rows, size, most, silent=None):
    out = {}
    for arm in {r[0] for r in rows}:
        recent, streak, before = [], 0, None
        for r in sorted((r for r in rows if r[0] == arm and r[2] is not None), key=lambda r: (r[2], r[1])):
            if silent and before and (r[2] - before).total_seconds() * 1_000 > silent:
                recent, streak = [], 0
            before, streak = r[2], streak + 1 if r[4] else 0
            recent = (recent + [r[3]] if r[3] is not None else recent)[-size:]
            out[r[1]] = (arm, r[1], sorted(recent)[(len(recent) + 1) // 2 - 1] if recent else None, streak, streak >= most)
    return out


def streamed(spark, folder, parts, lateness, **kw):
    for part in parts:
        spark.createDataFrame(part, RESULT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return {r["id"]: tuple(r) for r in live.write_figures(live.figures(stream, lateness, **kw), str(folder)).collect()}


def test_triggers_equal_the_answer_over_all_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):  # out of order by up to three seconds, two at one time now and then
        at = BASE + dt.timedelta(milliseconds=int((i * 100 + rng.integers(0, 3_000)) // 50 * 50))
        rows.append((["a", "b", None][int(rng.integers(0, 3))], i, at, None if rng.random() < 0.1 else float(rng.integers(0, 50)), None if rng.random() < 0.05 else bool(rng.random() < 0.6)))
    rows.append(("a", 5_000, None, 1.0, True))  # never due
    end = ("end", 10**6, BASE + dt.timedelta(days=1), None, None)
    got = streamed(spark, tmp_path, [rows[:300], rows[300:600], rows[600:], [end]], "5 seconds", size=20, most=3, silent_ms=10**9)
    due = plain(rows, 20, 3)
    assert {i: v for i, v in got.items() if i != 10**6} == due and any(v[4] for v in due.values())


def test_a_silent_arm_begins_anew_and_what_is_too_late_is_dropped(spark, tmp_path):
    at = lambda s: BASE + dt.timedelta(seconds=s)
    first = [("a", k, at(k), 10.0, True) for k in range(5)] + [("b", 100 + k, at(k), 7.0, True) for k in range(3)]
    tick = [("tick", 900, at(200), None, None)]
    later = [("a", 10 + k, at(300 + k), 3.0, k != 1) for k in range(3)] + [("a", 50, at(2), 99.0, True)] + [("b", 110, at(301), None, True)]
    end = [("tick", 901, at(900), None, None)]
    got = streamed(spark, tmp_path, [first, tick, later, end], "1 second", size=4, most=5, silent_ms=60_000)
    due = plain([r for r in first + later if r[1] != 50], 4, 5, silent=60_000)
    assert {i: v for i, v in got.items() if i < 900} == due
    assert due[4][3:] == (5, True) and due[10][2:] == (3.0, 1, False) and due[110][2] is None
