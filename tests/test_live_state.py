"""The state of live figures: a waiting result is written about once, however many triggers it waits for."""

import pickle

import numpy as np
import pandas as pd

from ruleloom.streaming import live


class Store:
    """State that counts what is written."""

    def __init__(self):
        self.held, self.timers, self.written = {}, [], 0

    def getListState(self, name, *_):
        return self.of(name, [])

    getValueState = getListState

    def getMapState(self, name, *_):
        return self.of(name, {})

    def registerTimer(self, ms):
        self.timers.append(ms)

    def of(self, name, empty):
        store = self

        class State:
            exists = lambda _: bool(store.held.get(name))
            get = lambda _: iter(store.held[name]) if isinstance(empty, list) and isinstance(store.held[name], list) else store.held[name]
            keys = lambda _: iter(list(store.held[name]))
            getValue = lambda _, k: store.held[name][k]
            removeKey = lambda _, k: store.held[name].pop(k)
            clear = lambda _: store.held.pop(name, None)

            def put(self, value):
                store.written += len(pickle.dumps(value))
                store.held[name] = value

            update = put

            def updateValue(self, k, value):
                store.written += len(pickle.dumps(value))
                store.held.setdefault(name, {})[k] = value

        return State()


class Timers:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def run(triggers, watermarks, size=20, most=3):
    store, arm = Store(), live.LiveFigures(size, most, 10**9)
    arm.init(store)
    got = []
    for new, ms in zip(triggers, watermarks):
        made = arm.handleInputRows(("a",), iter([new[: len(new) // 2], new[len(new) // 2 :]]), Timers(ms)) if len(new) else arm.handleExpiredTimer(("a",), Timers(ms), None)
        got += [(a, i, x if x == x else None, *more) for frame in made for a, i, x, *more in frame.itertuples(index=False)]
    return store, got


def due(rows, size=20, most=3):
    out, recent, streak = [], [], 0
    for _, i, x, failed in sorted(rows.itertuples(index=False), key=lambda r: r[:2]):
        streak = streak + 1 if failed else 0
        recent = (recent + [x] if x == x else recent)[-size:]
        out.append(("a", i, sorted(recent)[(len(recent) + 1) // 2 - 1] if recent else None, streak, streak >= most))
    return out


def frames(n, each, seed, spread):
    rng = np.random.default_rng(seed)
    at = np.arange(n * each) * 1_000 + rng.integers(0, spread, n * each) * 1_000
    rows = pd.DataFrame({"at_us": at, "id": rng.permutation(n * each), "latency": np.where(rng.random(n * each) < 0.1, np.nan, rng.integers(0, 50, n * each)), "failed": rng.random(n * each) < 0.6})
    return rows, [rows[k * each : (k + 1) * each].reset_index(drop=True) for k in range(n)]


def test_waiting_results_are_written_once():
    rows, parts = frames(20, 1_000, 1, 300)
    store, got = run([*parts, rows[:0]], [0] * 20 + [10**9])
    assert got == due(rows) and not store.held.get("waiting")
    assert store.written < 2 * 20_000 * 25


def test_results_in_overlapping_blocks_come_in_order(monkeypatch):
    for seed, (block, portion) in enumerate([(7, 20), (50, 1), (1_000, 10**6), (1, 5)]):
        monkeypatch.setattr(live, "BLOCK", block, raising=False)
        monkeypatch.setattr(live, "PORTION", portion, raising=False)
        rows, parts = frames(12, 60, seed, 150)
        store, got = run([*parts, rows[:0]], [max(0, k * 60 - 200) for k in range(12)] + [10**9])
        assert got == due(rows) and not store.held.get("waiting")
        assert store.timers[-1] > 10**9  # the arm is only awaited to fall silent
