"""What a streamed budget's task holds."""

import tracemalloc

import numpy as np
import pandas as pd

from ruleloom.streaming import budget


class Attempts:
    def groupBy(self, *_):
        return self

    def applyInPandasWithState(self, run, *_):
        return run


class State:
    exists = False

    def update(self, value):
        self.get, self.exists = value, True


def test_a_budget_of_many_attempts_is_held_as_numbers():
    """Well under 100 bytes an attempt; unknown costs keep their reservation, whatever the order."""
    n, size, cap = 200_000, 10_000, 150_000 * 10**9
    ids = np.random.default_rng(1).permutation(n)

    def batches():
        for at in range(0, n, size):
            i = ids[at:at + size]
            yield pd.DataFrame({"budget": ["b"] * size, "attempt_id": i, "reserved_nano": np.full(size, 10**9), "cost_nano": np.where(i % 4 != 0, 9e8, np.nan)})

    state, admitted = State(), 0
    tracemalloc.start()
    for out in budget.admit(Attempts(), cap)(("b",), batches(), state):
        admitted += int(out["admitted"].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    spent = due = 0
    for i in range(n):
        if spent + 10**9 <= cap:
            spent, due = spent + (9 * 10**8 if i % 4 else 10**9), due + 1
    assert (admitted, state.get) == (due, (spent,)) and peak < 100 * n
