"""Exact percentiles by refined histograms, and the word filter by rounds, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.operators import dedup, latency, percentiles

NAN, INF = float("nan"), float("inf")


def plain(values, q):
    v = sorted((x for x in values if x is not None), key=lambda x: (x != x, x))
    return v[max(1, math.ceil(q * len(v))) - 1] if v else None


def selected(df, qs):
    return {(r["g"], r["q"]): r["at"] for r in percentiles.percentiles(df, ["g"], "v", qs).collect()}


def test_percentiles_of_odd_groups(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "BUCKETS", 32)
    monkeypatch.setattr(percentiles, "FEW", 3)
    rng = np.random.default_rng(0)
    groups = {
        "normal": rng.standard_normal(500).tolist(), "steep": (10.0 ** rng.integers(-300, 300, 300)).tolist(), "same": [7.0] * 50, "two": [1.0, 2.0], "one": [3.0], None: rng.integers(0, 9, 200).astype(float).tolist(),
        "wild": [NAN] * 20 + [INF] * 20 + [-INF] * 20 + rng.standard_normal(20).tolist(), "nan": [NAN] * 9, "wide": [-1.7e308, 1.7e308] * 10 + [0.0, -0.0, 5e-324] * 5, "nulls": [None, 1.0, None], "infinite": [INF, -INF] * 5,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows + [("none", None)], "g string, v double").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = selected(df, qs)
    for g, vs in groups.items():
        for q in qs:
            due = plain(vs, q)
            assert got[g, q] == due or (due != due and got[g, q] != got[g, q]), (g, q)
    assert not [k for k in got if k[0] == "none"]
    s = {r["g"]: r for r in latency.summary(df, ["g"], "v").collect()}
    assert s["none"]["n"] == 0 and s["none"]["p50"] is None and s["two"]["p50"] == 1.0 and s[None]["p95"] == plain(groups[None], 0.95)
    assert percentiles.percentiles(df.limit(0), ["g"], "v", qs).count() == 0


def test_percentiles_of_many_different_values(spark):
    """Two million different values of one group, none of whose parts a task sorts whole."""
    n = 2_000_000
    df = spark.range(n, numPartitions=8).select(F.lit("g").alias("g"), F.pow(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 20), 2).alias("v"))
    v = np.sort(np.array(df.select("v").toPandas()["v"]))
    assert selected(df, [0.5, 0.95, 0.99]) == {("g", q): v[math.ceil(q * n) - 1] for q in (0.5, 0.95, 0.99)}


def one_by_one(rows):
    """Indices that a filter keeps which goes through the words in order."""
    letters, seen, out = sorted({c for _, w in rows if w for c in w.lower()}), set(), []
    for i, w in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0], r[1])):
        low = w.lower()
        places = range(len(low) + 1)
        near = {low} | {low[:k] + low[k + 1:] for k in places} | {low[:k] + c + low[k + 1:] for k in places for c in letters} | {low[:k] + c + low[k:] for k in places for c in letters}
        if not near & seen:
            seen.add(low)
            out.append((i, w))
    return out


@pytest.mark.parametrize("seed,n,letters,lengths", [(0, 20_000, "abcdefgh", (4, 8)), (1, 800, "ab", (0, 9))])
def test_word_filter_against_one_by_one(spark, seed, n, letters, lengths):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), int(rng.integers(*lengths)))) for _ in range(n)]
    rows = [(int(rng.integers(0, n // 2)), w.capitalize() if i % 3 else w) for i, w in enumerate(words)] + [(5, None), (5, "Ünïx"), (5, "ünïx"), (6, "ÜNÏ")]
    rows = sorted(set(rows), key=str)
    got = dedup.spread(spark.createDataFrame(rows, "i long, w string").repartition(6), "w", ["i"])
    assert sorted(map(tuple, got.collect())) == sorted(one_by_one(rows))


def test_word_filter_of_a_long_row_of_waiting_words_and_of_none(spark):
    chain = [(k, "a" * (k + 1)) for k in range(40)]  # each waits for the one before
    got = dedup.spread(spark.createDataFrame(chain + chain[:3], "i long, w string"), "w", ["i"])
    assert sorted(r["i"] for r in got.collect()) == list(range(0, 40, 2))
    assert dedup.spread(spark.createDataFrame([], "i long, w string"), "w", ["i"]).count() == 0
