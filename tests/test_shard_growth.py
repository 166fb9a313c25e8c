"""Shards of a large bank: cases are worked out once, large groups aren't sorted, buckets aren't composed unit by unit."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.operators import sampling as M
from ruleloom.operators import shards as S
from ruleloom.operators.scan import Steps, composed

CASE = "case_id long, workflow string, stratum string, family long, base long, split string, ambiguous boolean, repeated boolean"


def test_cases_are_worked_out_once(spark):
    rows = [(k * 10 + j, "abc"[k % 3], [None, "x", "y"][k % 7 % 3], k * 10, None if j == 0 else k * 10, "holdout" if k % 5 == 0 else "dev", k % 11 == 0, j == 0 and k % 13 == 0 and k % 5 > 0) for k in range(300) for j in range(k % 3 + 1)]
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(len(b))
            yield b

    cases = spark.createDataFrame(rows, CASE).mapInPandas(told, CASE)
    got = S.plan(cases, S.Targets(pilot=3, load=4, broad=50, siblings=20, holdout=30, holdout_strata=("x",)), 40, "s").collect()
    assert read.value == len(rows)
    assert {r["case_id"] for r in got} == {r[0] for r in rows}


@pytest.mark.parametrize("seed", range(30))
def test_a_bucket_is_the_function_that_its_units_compose_to(seed):
    rng = np.random.default_rng(seed)
    most = int(rng.integers(1, 60))
    sizes = rng.integers(1, [2, 4, 30, 90][seed % 4], int(rng.integers(1, 50)))
    one = S.steps(sizes, most)
    due = list(composed(Steps([0, max(0, most - z) + 1], [1, 0], [z, z], [0, 1]) for z in sizes.tolist()))
    assert len(due) == 1
    for used in range(0, 95):
        assert one(used) == due[0](used), (sizes, most, used)
        at, full = [], used  # and where the shards begin
        for i, z in enumerate(sizes.tolist()):
            if full and full + z > most:
                at, full = [*at, i], 0
            full += z
        assert S.starts(sizes, most, used) == at and (full, len(at)) == one(used)


def test_the_first_of_a_group_are_among_few(spark):
    key = lambda i: hashlib.sha256(f"s|{i}".encode()).hexdigest()
    rows = [(None if i % 3 == 0 else "a" if i % 3 == 1 else f"g{i % 50}", i) for i in range(6_000)]
    df = spark.createDataFrame(rows, "g string, i long")
    near = M.foremost(df, ["g"], M.shuffle_key("s", F.col("i")), 20).collect()
    assert len(near) < 3_000
    for g in {r[0] for r in rows}:
        due = sorted((i for h, i in rows if h == g), key=key)[:20]
        assert due == sorted((r["i"] for r in near if r["g"] == g), key=key)[:20]
    # keys that aren't dealt evenly: a short group is taken whole, others are not
    some = F.when(F.col("g") == "a", F.lit("f" * 64)).otherwise(M.shuffle_key("s", F.col("i")))
    near = M.foremost(df, ["g"], some, 20).collect()
    assert sum(r["g"] == "a" for r in near) == 2_000 and sum(r["g"] is None for r in near) < 200
    assert M.foremost(df.limit(0), ["g"], some, 20).count() == 0
