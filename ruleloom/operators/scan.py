"""Order-dependent folds at scale: an associative scan over step functions.

Some states can't be told from sums: whether an attempt is admitted under a cap
depends on which ones were before it, and where a shard begins on where the last
one ended. Both are folds of steps that map a whole number to a whole number, by
few pieces: ``s + b`` or a constant ``b`` from some ``s`` on. Such functions can be
composed, so a bucket of steps is one function whatever state it is entered with.

1. Tasks compose the steps of a bucket. A function of more than PIECES pieces is
   left as it is and another begun, so that what a task holds has a bound.
2. The functions, one or a few for each bucket, are gone through in order, as a
   stream of sorted rows: this gives the state that each bucket is entered with.
3. Tasks go through their buckets' steps from there.

Only the second step is serial within a key, and it reads functions, not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces of a function at most before another is begun.
PIECES = 4_096
PLAIN, PACKED = ("bound", "plain_add", "plain_count"), ("lo", "keep", "add", "counts")


class Steps:
    """A function by pieces: from ``lo`` on, ``keep * s + add``, and ``count`` more of
    what is counted (admitted attempts, begun shards)."""

    __slots__ = ("lo", "keep", "add", "count")

    def __init__(self, lo, keep, add, count) -> None:
        self.lo, self.keep, self.add, self.count = (np.asarray(x, np.int64) for x in (lo, keep, add, count))

    def __call__(self, s: int) -> tuple[int, int]:
        k = int(np.searchsorted(self.lo, s, "right")) - 1
        return int(self.keep[k]) * s + int(self.add[k]), int(self.count[k])

    def then(self, g: Steps) -> Steps:
        """g after this function."""
        ends = np.append(self.lo[1:] - 1, 1 << 62)
        moved = self.keep == 1
        first = np.where(moved, self.lo + self.add, self.add)
        last = np.where(moved, ends + self.add, self.add)
        a, z = np.searchsorted(g.lo, first, "right") - 1, np.searchsorted(g.lo, last, "right") - 1
        n = z - a + 1
        mine = np.repeat(np.arange(len(n)), n)
        of = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        inner = of != a[mine]  # a piece of g that begins inside one of these
        lo = np.where(inner, g.lo[of] - self.add[mine], self.lo[mine])
        keep, add = self.keep[mine] * g.keep[of], g.keep[of] * self.add[mine] + g.add[of]
        count = self.count[mine] + g.count[of]
        new = np.ones(len(lo), bool)  # equal neighbours are one piece
        new[1:] = (keep[1:] != keep[:-1]) | (add[1:] != add[:-1]) | (count[1:] != count[:-1])
        return Steps(lo[new], keep[new], add[new], count[new])

    def packed(self) -> list[bytes]:
        return [x.astype("<i8").tobytes() for x in (self.lo, self.keep, self.add, self.count)]

    @staticmethod
    def unpacked(*data: bytes) -> Steps:
        return Steps(*(np.frombuffer(x, "<i8") for x in data))


def composed(steps: Iterator[Steps]) -> Iterator[Steps]:
    """One function for all steps, or several in a row where one would have too many pieces."""
    whole = None
    for f in steps:
        whole = f if whole is None else whole.then(f)
        if len(whole.lo) > PIECES:
            yield whole
            whole = None
    if whole is not None:
        yield whole


def entered(made: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """(keys, bucket, entered, counted): the state and the count that each bucket is entered with.

    ``made`` has the buckets' functions: keys, bucket, part, the columns of PACKED, and where
    there are such, those of PLAIN and begin, the first state of a key."""
    for c in ("begin", *PLAIN):
        if c not in made.columns:
            made = made.withColumn(c, F.lit(None if c == "bound" else 0).cast("long"))
    sorted_ = made.withColumn("begin", F.coalesce("begin", F.lit(0)).cast("long")).repartition(*keys).sortWithinPartitions(*keys, bucket, "part")
    sorted_ = sorted_.select(*keys, bucket, "part", *PLAIN, *PACKED, "begin")
    key_types = ", ".join(f"{k} {made.schema[k].dataType.simpleString()}" for k in [*keys, bucket])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, count, skipped = None, 0, 0, False
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                key = row[: len(keys)]
                if key != at:
                    at, state, count = key, int(row.begin), 0
                if row.part == 0:
                    found.append((*row[: len(keys) + 1], state, count))
                    skipped = row.bound == row.bound and row.bound is not None and state < row.bound
                    if skipped:
                        state, count = state + int(row.plain_add), count + int(row.plain_count)
                if not skipped:
                    state, more = Steps.unpacked(*(getattr(row, c) for c in PACKED))(state)
                    count += more
            yield pd.DataFrame(found, columns=[*keys, bucket, "entered", "counted"])

    return sorted_.mapInPandas(walk, f"{key_types}, entered long, counted long")


def folded(rows: DataFrame, keys: list[str], order: list[str], bucket: str, step: Callable, take: Callable, out: str, begin: DataFrame | None = None, shortcut: Callable | None = None) -> DataFrame:
    """``rows`` with the columns of ``out`` ("name type, ..."), folded in the order of
    ``order`` within ``keys``.

    ``bucket`` is a column that grows with ``order``. ``step(frame)`` gives a bucket's
    rows as Steps; ``take(frame, state, count)`` the columns of ``out`` for a bucket that
    is entered with a state and a count. ``begin`` (keys, state) has first states
    that aren't 0. ``shortcut(frame)`` may tell (bound, add, count): what the whole bucket
    does to states under the bound, which its steps need not know then."""
    columns = rows.columns
    key_types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in [*keys, bucket])
    names = [f.split()[0] for f in out.split(", ")]

    def functions(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        plain = (None, 0, 0) if shortcut is None else shortcut(frame)
        made = pd.DataFrame([(i, *plain, *f.packed()) for i, f in enumerate(composed(iter(step(frame))))], columns=["part", *PLAIN, *PACKED]).astype({"bound": "Int64"})
        for k in reversed([*keys, bucket]):
            made.insert(0, k, [frame[k].iloc[0]] * len(made))
        return made

    made = rows.groupBy(*keys, bucket).applyInPandas(functions, f"{key_types}, part int, {', '.join(f'{c} long' for c in PLAIN)}, {', '.join(f'{c} binary' for c in PACKED)}")
    if begin is not None:
        made = made.join(begin.select(*keys, F.col("state").alias("begin")), keys, "left")
    met = rows.join(entered(made, keys, bucket), [*keys, bucket])

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        values = take(frame, int(frame["entered"].iloc[0]), int(frame["counted"].iloc[0]))
        return pd.concat([frame[columns].reset_index(drop=True), pd.DataFrame(dict(zip(names, values)))], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return met.groupBy(*keys, bucket).applyInPandas(go, f"{schema}, {out}")


def even_buckets(rows: DataFrame, key: Column, size: int) -> Column:
    """Buckets of about ``size`` rows along a key that is a SHA-256 in hexadecimal."""
    n = max(1, -(-rows.count() // size))
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n / 2**32).cast("long")
