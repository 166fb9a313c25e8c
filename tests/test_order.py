"""Folds that depend on all earlier rows, against plain loops: budgets, shards, phases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.operators import budgets, planning, scan, shards
from ruleloom.operators.sampling import shuffle_key

ATTEMPT = "budget string, attempt_id long, reserved_nano long, cost_nano long"


def key(seed, x):
    return hashlib.sha256(f"{seed}|{x}".encode()).hexdigest()


def loop(rows, cap):
    spent, out = {}, {}
    for b, i, reserved, cost in sorted(rows, key=lambda r: r[1]):
        x = spent.get(b, 0)
        ok = x + reserved <= cap
        spent[b] = x + ((reserved if cost is None else cost) if ok else 0)
        out[b, i] = (ok, spent[b])
    return out


def random_attempts(seed, n, over=False):
    rng = np.random.default_rng(seed)
    sizes = [lambda: 100, lambda: int(rng.integers(1, 200)), lambda: int(rng.choice([0, 1, 50, 1_000]))][seed % 3]
    rows = []
    for i in rng.permutation(n).tolist():
        r = sizes()
        # a third of all attempts have one budget and more; costs may be over what was reserved
        rows.append(([None, "a", "hot"][min(2, int(rng.integers(0, 8)))], i * 3 - 50, r, None if rng.random() < 0.2 else int(rng.integers(0, r * (2 if over else 1) + 1))))
    return rows


def decisions(df):
    return {(r["budget"], r["attempt_id"]): (r["admitted"], r["spent_nano"]) for r in df.collect()}


@pytest.mark.parametrize("seed,cap,pieces", [(0, 60_000, 4_096), (1, 30_000, 4_096), (2, 20_000, 5), (4, 10**9, 4_096), (5, 500, 3)])
def test_admission_and_resumption_against_a_loop(spark, monkeypatch, seed, cap, pieces):
    monkeypatch.setattr(budgets, "BUCKET", 40)
    monkeypatch.setattr(scan, "PIECES", pieces)
    rows = random_attempts(seed, 2_500, over=seed == 5)
    df, due = spark.createDataFrame(rows, ATTEMPT).repartition(7), loop(rows, cap)
    got = budgets.admitted(df, cap)
    assert got.schema.simpleString() == spark.createDataFrame([], budgets.DECISIONS).schema.simpleString()
    assert decisions(got) == due
    # a log of the first attempts: those are left alone, the rest decided as if nothing had been between
    log = spark.createDataFrame([(*k, *v) for k, v in due.items() if k[1] < 2_000], budgets.DECISIONS)
    assert decisions(budgets.admitted(df, cap, log)) == {k: v for k, v in due.items() if k[1] >= 2_000}
    assert {r["budget"]: r["spent_nano"] for r in budgets.spend(log).collect()} == {b: max(v[1] for k, v in due.items() if k[0] == b and k[1] < 2_000) for b in {k[0] for k in due}}


def test_a_large_budget_is_many_tasks(spark):
    n, cap = 300_000, 90_000_000
    df = spark.range(n).select(F.lit("one").alias("budget"), F.col("id").alias("attempt_id"), (F.pmod(F.xxhash64("id"), F.lit(1_000)) + 1).alias("reserved_nano"), F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(900))).alias("cost_nano"))
    got = budgets.admitted(df, cap).orderBy("attempt_id").toPandas()
    rows = [("one", r[0], r[1], r[2]) for r in df.select("attempt_id", "reserved_nano", "cost_nano").collect()]
    due = loop(rows, cap)
    assert got["admitted"].tolist() == [due["one", i][0] for i in range(n)] and got["spent_nano"].tolist() == [due["one", i][1] for i in range(n)]
    assert 0 < got["admitted"].sum() < n
    plan = budgets._bucketed(budgets._checked(df)).groupBy("bucket").count().collect()
    assert len(plan) >= n // budgets.BUCKET and max(r["count"] for r in plan) <= budgets.BUCKET


def test_admission_of_odd_rows(spark):
    assert budgets.admitted(spark.createDataFrame([], ATTEMPT), 5).count() == 0
    again = budgets.admitted(spark.createDataFrame([("a", 1, 3, None), ("a", 1, 3, None), ("a", 2, 0, 0), ("b", 1, 9, 1)], ATTEMPT), 5)
    assert sorted(map(tuple, again.collect())) == [("a", 1, False, 3), ("a", 1, True, 3), ("a", 2, True, 3), ("b", 1, False, 0)]
    for bad in [("a", 1, None, 1), ("a", 1, -1, 1), ("a", 1, 2, -1)]:
        with pytest.raises(Exception, match="null or negative"):
            budgets.admitted(spark.createDataFrame([bad], ATTEMPT), 5).collect()


def test_a_restarted_stream_goes_on_from_its_log(spark, tmp_path):
    rows, cap, source = random_attempts(1, 900), 9_000, tmp_path / "in"
    rows.sort(key=lambda r: r[1])
    stream = lambda: spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = lambda: budgets.stream_admitted(stream(), cap, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    for part in range(3):
        spark.createDataFrame(rows[part * 300: part * 300 + 300], ATTEMPT).coalesce(1).write.mode("append").parquet(str(source))
        if part != 1:  # the second run finds two files, one trigger each
            run()
    done = spark.read.schema(budgets.DECISIONS).parquet(f"{tmp_path}/out/rows")
    assert done.count() == 900
    got = decisions(done)
    order = {r[:2]: r for r in rows}
    assert set(got) == set(order)
    assert got == loop(rows, cap)


def fold_shards(units, most):
    shard, used, out = 0, 0, {}
    for name, size, _ in sorted(units, key=lambda u: (u[2], u[0])):
        if used and used + size > most:
            shard, used = shard + 1, 0
        used += size
        out[name] = (size, shard)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_packed_shards_against_the_fold(spark, monkeypatch, seed):
    monkeypatch.setattr(shards, "UNITS", 30)
    if seed:
        monkeypatch.setattr(scan, "PIECES", 4)
    rng = np.random.default_rng(seed)
    units = [(f"u{i}", int(rng.choice([1, 2, 3, 7, 12, 50, 90, 130])), key("s", f"u{i}")) for i in range(1_500)]
    df = spark.createDataFrame(units, "u string, n int, k string").repartition(5)
    got = {r["u"]: (r["size"], r["shard"]) for r in shards.packed(df, "u", "n", 100, F.col("k")).collect()}
    assert got == fold_shards(units, 100)
    assert shards.packed(df.limit(0), "u", "n", 100, F.col("k")).count() == 0


def test_every_case_has_one_place_and_parts_follow_each_other(spark):
    rng = np.random.default_rng(3)
    rows = []
    for f in range(400):
        split, n = ("holdout" if f % 5 == 0 else "dev"), int(rng.integers(1, 5))
        for j in range(n):
            c = f * 10 + j
            rows.append((c, ["chart", "inbox"][f % 2], [None, "x", "y", "z"][int(rng.integers(0, 4))], f, None if j == 0 else f * 10, split, bool(rng.random() < 0.1), j == 0 and split == "dev" and f % 23 == 1))
    rows.append((9_999, "chart", "x", 9_999, None, "other", None, None))
    cases = spark.createDataFrame(rows, "case_id long, workflow string, stratum string, family long, base long, split string, ambiguous boolean, repeated boolean").repartition(4)
    t = shards.Targets(pilot=5, load=3, broad=60, siblings=40, holdout=50, holdout_strata=("z",))
    out = [tuple(r) for r in shards.plan(cases, t, 70, "s").collect()]
    by = {r[0]: r for r in rows}
    phase = {}
    for c, shard, p, rep in out:
        phase.setdefault((p, shard == 0), []).append(c)
    pilot, broad, whole, held = (set(phase[p, True]) for p in ("pilot", "broad", "counterfactual", "holdout"))
    siblings = {}
    for r in rows:
        if r[4] is not None and r[5] == "dev":
            siblings.setdefault(r[3], set()).add(r[0])
    assert len(pilot) == 10 and all(by[c][4] is None and by[c][5] == "dev" and not by[c][6] and not by[c][7] and by[c][3] not in siblings for c in pilot)
    repeated = {c for c, r in by.items() if r[7]}
    assert len(broad) == 60 and repeated <= broad and not broad & pilot and len(phase["repeat", True]) == 3 * len(repeated)
    families = [s for s in siblings.values() if s & whole]
    begun = {f for f, s in siblings.items() if f * 10 in broad | pilot}
    assert whole == set().union(*families) and {by[c][3] for c in whole} <= begun
    assert len(whole) >= min(40, sum(len(siblings[f]) for f in begun)) and len(whole) < 40 + 4
    assert len(held) == 50 and {c for c, r in by.items() if r[5] == "holdout" and r[2] == "z"} <= held
    assert all(len(phase[p, True]) == 6 for p in t.load_reps)
    # all other cases of both splits, once each, families together
    later = [(c, shard) for c, shard, p, rep in out if shard > 0]
    assert sorted(c for c, _ in later) == sorted(set(by) - {9_999} - pilot - broad - whole - held)
    place, units = dict(later), {}
    for c in place:
        units.setdefault(f"case-{c}" if by[c][5] == "holdout" else f"family-{by[c][3]}", []).append(c)
    due = fold_shards([(u, len(cs), key("s-pack", u)) for u, cs in units.items()], 70)
    assert all(place[c] == due[u][1] + 1 for u, cs in units.items() for c in cs)


def fold_phases(cases, quotas, seed):
    picked = {}
    for name, fits, n, reps in quotas:
        count = {}
        for i, s in sorted(cases, key=lambda c: (key(seed, c[0]), c[0])):
            if i not in picked and fits(i) and (n is None or count.get(s, 0) < n):
                picked[i] = (name, reps)
                count[s] = count.get(s, 0) + 1
    return sorted((i, name, r) for i, (name, reps) in picked.items() for r in range(1, reps + 1))


def test_what_a_full_phase_refuses_goes_on(spark):
    cases = [(i, f"s{i % 2}" if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(cases, "id long, s string").repartition(3)
    # the case of a pilot that takes two of the fifty even ones, and a broad phase that fits all
    hundred = df.where("id < 100").withColumn("s", F.lit("one"))
    got = planning.phases(hundred, "id", "s", [("pilot", F.col("id") % 2 == 0, 2, 1), ("broad", F.lit(True), None, 1)], "x").groupBy("phase").count().collect()
    assert {r["phase"]: r["count"] for r in got} == {"pilot": 2, "broad": 98}
    tests = [("a", lambda i: i % 2 == 0, 5, 1), ("b", lambda i: i % 3 == 0, 7, 2), ("whole", lambda i: i % 5 == 0, None, 1), ("c", lambda i: True, 60, 1), ("rest", lambda i: i % 7 == 0, None, 3)]
    columns = {"a": F.col("id") % 2 == 0, "b": F.when(F.col("id") % 3 == 0, True), "whole": F.col("id") % 5 == 0, "c": F.lit(True), "rest": F.col("id") % 7 == 0}
    out = planning.phases(df, "id", "s", [(n, columns[n], k, r) for n, _, k, r in tests], "x")
    assert sorted(map(tuple, out.collect())) == fold_phases(cases, tests, "x")
    assert planning.phases(df.limit(0), "id", "s", [("a", F.lit(True), 1, 1)], "x").count() == 0
