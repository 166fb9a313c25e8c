"""Attempt chains and compared bodies against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import attempts as T
from ruleloom.operators import bodies as B


def _plain_chains(rows):
    """rows: (trial, no, kind, b, e) -> trial -> figures, in order of number."""
    by = {}
    for t, no, kind, b, e in rows:
        by.setdefault(t, {}).setdefault(no or 0, []).append((b, e, kind))
    out = {}
    for t, numbers in by.items():
        first = {no: min(v) for no, v in numbers.items()}
        f = dict.fromkeys(("repeated", "gaps", "unasked", "beyond", "early", "late"), 0)
        for no, (b, _, kind) in first.items():
            f["repeated"] += len(numbers[no]) > 1
            f["beyond"] += no > 3
            p = first.get(no - 1)
            if no < 1 or (no > 1 and p is None):
                f["gaps"] += 1
            elif no > 1:
                f["unasked"] += p[2] != "retryable"
                due = {2: 1.0, 3: 4.0}.get(no)
                if due is not None:
                    f["early"] += (b - p[1]) / 1e6 < due
                    f["late"] += (b - p[1]) / 1e6 > due + 0.75
        last = max(first)
        kind = first[last][2]
        outcome = kind if kind != "retryable" else "exhausted" if last > 2 else "cut_short"
        out[t] = (sum(map(len, numbers.values())), last, outcome, *f.values(), not any(f.values()))
    return out


def test_chains_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for t in range(200):
        clock = 0
        for no in rng.choices([[1], [1, 2], [1, 2, 3], [1, 3], [2], [1, 2, 3, 4, 5], [1, 1, 2], [None, 1]], [5, 5, 5, 1, 1, 1, 1, 1])[0]:
            begin = clock + rng.choice([900_000, 1_000_000, 1_100_000, 1_800_000, 4_100_000])
            clock = begin + rng.randrange(1, 2_000_000)
            rows.append((t if t else None, no, rng.choice(["retryable"] * 5 + ["ok", "fatal", "final", "aborted"]), begin, clock))
    df = spark.createDataFrame(rows, "trial int, no int, kind string, b long, e long")
    got = {r[0]: tuple(r)[1:] for r in T.chains(df, ["trial"], "no", F.col("kind"), "b", "e").collect()}
    assert got == _plain_chains(rows)


def test_a_trial_of_many_attempts_is_spread_and_an_empty_table_is_fine(spark):
    hot = spark.range(1, 100_001, numPartitions=4).select(F.lit("t").alias("trial"), F.col("id").alias("no"), (F.col("id") * 3_000_000).alias("b"), (F.col("id") * 3_000_000 + 1).alias("e"))
    r = T.chains(hot, ["trial"], "no", F.lit("retryable"), "b", "e").first()
    assert (r["attempts"], r["outcome"], r["gaps"], r["beyond"], r["early"], r["late"]) == (100_000, "exhausted", 0, 99_997, 1, 1)
    plan = T.chains(hot, ["trial"], "no", F.lit("retryable"), "b", "e")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert T.chains(hot.limit(0), ["trial"], "no", F.lit("ok"), "b", "e").count() == 0


@pytest.mark.parametrize("status, error, kind", [
    (200, None, "ok"), (204, "", "ok"), (200, "bad_json", "final"), (429, None, "retryable"), (500, "http_500", "retryable"), (599, None, "retryable"), (401, None, "fatal"), (404, "http_404", "fatal"), (400, None, "final"),
    (422, "http_422", "final"), (None, "timeout", "retryable"), (None, "network_error: reset", "retryable"), (None, "aborted", "aborted"), (None, None, "aborted"), (None, "odd", "final"), (301, None, "final")])
def test_classes(spark, status, error, kind):
    df = spark.createDataFrame([(status, error)], "status int, error string")
    assert df.select(T.outcome_class(F.col("status"), F.col("error"))).first()[0] == kind


def test_only_attempts_past_the_grace_of_their_own_segment_are_late(spark):
    rows = [("a", 1, "fatal", 0, 10), ("a", 2, "ok", 2_000_010, 9), ("a", 3, "ok", 2_000_011, 9), ("b", 4, "ok", 9_000_000, 9), (None, 5, "fatal", 0, 5), (None, 6, "ok", 3_000_000, 9)]
    df = spark.createDataFrame(rows, "segment string, i int, kind string, b long, e long")
    assert sorted(r["i"] for r in T.after_fatal(df, "segment", F.col("kind"), "b", "e").collect()) == [3, 6]


def _flat(v, path="$"):
    if isinstance(v, dict) and v:
        return {p: x for k in v for p, x in _flat(v[k], f"{path}.{k}").items()}
    if isinstance(v, list) and v:
        return {p: x for i, y in enumerate(v) for p, x in _flat(y, f"{path}[{i}]").items()}
    return {path: json.dumps(v, separators=(",", ":"))}


def _random_tree(rng, depth):
    kind = rng.choice(["n", "s", "b", "null", "d", "l"] if depth else ["n", "s", "b", "null"])
    if kind == "d":
        return {k: _random_tree(rng, depth - 1) for k in rng.sample("abcd", rng.randrange(4))}
    if kind == "l":
        return [_random_tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {"n": rng.randrange(5), "s": rng.choice(["", "x", "y z"]), "b": rng.random() < 0.5, "null": None}[kind]


def test_differences_equal_a_plain_walk(spark):
    rng = random.Random(3)
    pairs = [(i, _random_tree(rng, 4), None) for i in range(150)]
    pairs = [(i, a, a if i % 5 == 0 else _random_tree(rng, 4)) for i, a, _ in pairs]
    left = spark.createDataFrame([(i, json.dumps(a)) for i, a, _ in pairs], "i int, body string")
    right = spark.createDataFrame([(i, json.dumps(b, indent=1)) for i, _, b in pairs], "i int, body string")
    want = {}
    for i, a, b in pairs:
        fa, fb = _flat(a), _flat(b)
        off = sorted(p for p in fa.keys() | fb.keys() if fa.get(p) != fb.get(p))
        if off:
            want[i] = ("differs", len(off), off[0], fa.get(off[0]), fb.get(off[0]))
    assert {r["i"]: tuple(r)[1:] for r in B.differences(left, right, "i", "body").collect()} == want


def test_differences_on_odd_rows(spark):
    left = [(1, '{"a":1,"b":[]}'), (2, "no json"), (3, None), (4, '{"a":1}'), (5, "{}"), (6, "null"), (None, '{"k":1}'), (7, '{"a":{"b":{"c":1,"d":2}}}'), (8, ""), (9, '{"a":1,"a":2}')]
    right = [(1, ' {"b": [ ], "a": 1} '), (2, "no  json"), (3, "[]"), (5, "[]"), (6, None), (None, '{"k":2}'), (7, '{"a":{"b":{"d":2,"c":3}}}'), (8, ""), (9, '{"a":1,"a":3}')]
    l, r = (spark.createDataFrame(x, "i int, body string") for x in (left, right))
    got = {x["i"]: tuple(x)[1:] for x in B.differences(l, r, "i", "body").collect()}
    assert got == {2: ("differs", 1, "$", "no json", "no  json"), 3: ("right_only", 1, "$", None, "[]"), 4: ("left_only", 1, "$.a", "1", None), 5: ("differs", 1, "$", "{}", "[]"), 6: ("left_only", 1, "$", "null", None),
                   None: ("differs", 1, "$.k", "1", "2"), 7: ("differs", 1, "$.a.b.c", "1", "3"), 9: ("differs", 1, "$", '{"a":1,"a":2}', '{"a":1,"a":3}')}
    shallow = {x["i"]: tuple(x)[1:] for x in B.differences(l.where("i = 7"), r.where("i = 7"), "i", "body", depth=2).collect()}
    assert shallow == {7: ("differs", 1, "$.a.b", '{"c":1,"d":2}', '{"c":3,"d":2}')}
    assert B.differences(l.limit(0), r.limit(0), "i", "body").count() == 0
