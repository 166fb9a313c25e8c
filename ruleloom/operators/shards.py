"""Shards of trials over a bank of cases: a core shard, and the rest packed whole.

The core shard is chosen in steps, each from what the ones before really took: a
pilot and load samples by turns over strata, a broad sample in proportion to
strata that fills up what repeated cases leave of its target, whole families of
siblings whose base is among those, until their target is reached, and holdout
cases up to theirs. Strata and families are cut by ranks of tasks' first rows and by
running sums, bucket by bucket; the picks of a step are a table as large as its target.

All other cases are packed whole in one shuffled order: a holdout case by itself, the
cases of a family together. A shard begins with the unit that doesn't fit the one
before, so where it begins depends on all earlier units: a fold by ``scan.folded``.

``cases``: case_id, workflow, stratum, family, base (the id of a sibling's base case;
null for a base), split ("dev", "holdout"; others take no part), ambiguous, repeated
(booleans, null is false). Case ids are unique. Rows with a null stratum or workflow are a
stratum or workflow of their own. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions.text import bound
from ruleloom.operators.sampling import carried, foremost, hash_bucket, proportional, shuffle_key
from ruleloom.operators.scan import PACKED, Steps, entered, even_buckets
from ruleloom.sources.shared import kept

#: Units of a bucket when shards are packed, about.
UNITS = 4_096


@dataclass(frozen=True)
class Targets:
    """How many cases the parts of a core shard have, and which strata are for holdout alone."""

    pilot: int = 30
    load: int = 50
    load_reps: dict[str, int] = field(default_factory=lambda: {"load_c1": 10, "load_c2": 11, "load_c4": 12, "load_c8": 13})
    broad: int = 4_300
    siblings: int = 1_000
    holdout: int = 3_000
    repeats: int = 3
    holdout_strata: tuple[str, ...] = ()


def by_turns(rows: DataFrame, group: str | None, stratum: str, id_: str, n: int | Column, most: int, seed: str) -> DataFrame:
    """The ids of ``n`` rows of each group (``most`` at least), one from each stratum in
    turn until strata are empty; strata and their rows in shuffled order."""
    groups = [group] if group else []
    key, order = shuffle_key(seed, F.col(id_)), shuffle_key(seed, F.col(stratum))
    near = foremost(rows.select(*groups, stratum, id_), [*groups, stratum], key, most)
    first = near.select(*groups, stratum, id_, key.alias("key")).withColumn("rn", F.row_number().over(Window.partitionBy(*groups, stratum).orderBy("key", id_))).where(F.col("rn") <= most)
    turn = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    # no group has more than ``most`` rows of a stratum here
    return first.withColumn("turn", F.row_number().over(turn.orderBy("rn", order, stratum))).where(F.col("turn") <= n).select(id_)


def until(rows: DataFrame, id_: str, size: str, target: int, seed: str) -> DataFrame:
    """Rows in shuffled order until their sizes reach ``target``; the one that reaches it is the last."""
    key = shuffle_key(seed, F.col(id_))
    return carried(rows, [], [key, id_], hash_bucket(key), "sum", F.col(size), "before").where(F.coalesce("before", F.lit(0)) < target).drop("before")


def core(cases: DataFrame, targets: Targets, seed: str) -> DataFrame:
    """(case_id, phase, rep) of the core shard."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    dev, holdout = cases.where("split = 'dev'"), cases.where("split = 'holdout'")
    bases, siblings = dev.where("base is null"), dev.where("base is not null")
    repeated = cases.where(flag("repeated")).select("case_id")
    plain = dev.where(~flag("ambiguous"))

    alone = kept(plain.where(F.col("base").isNull() & ~flag("repeated")).join(siblings.select("family").distinct(), "family", "left_anti").select("workflow", "stratum", "case_id"))
    pilot = kept(by_turns(alone, "workflow", "stratum", "case_id", targets.pilot, targets.pilot, f"{seed}-pilot"))
    load = [by_turns(plain, "workflow", "stratum", "case_id", targets.load, targets.load, f"{seed}-{phase}").select("case_id", F.lit(phase).alias("phase"), F.lit(rep).alias("rep")) for phase, rep in targets.load_reps.items()]

    rest = bases.where(~flag("repeated")).join(pilot, "case_id", "left_anti").select("case_id", "stratum")
    room = max(0, targets.broad - repeated.count())
    near = foremost(rest, ["stratum"], shuffle_key(f"{seed}-broad", F.col("case_id")), room)
    broad = kept(repeated.unionByName(proportional(rest, "stratum", "case_id", room, f"{seed}-broad", near).select("case_id")))

    begun = pilot.unionByName(broad).select(F.col("case_id").alias("base"))
    # what was kept is known to be small before siblings would be shuffled to meet it
    met = kept(siblings.join(begun, "base", "left_semi").select("family").distinct())
    fam = siblings.join(met, "family", "left_semi").groupBy("family").agg(F.count("*").alias("n"))
    cut = kept(until(fam, "family", "n", targets.siblings, f"{seed}-cf").select("family"))
    whole = kept(siblings.join(cut, "family", "left_semi").select("case_id"))

    only = holdout.where(F.col("stratum").isin(list(targets.holdout_strata)) if targets.holdout_strata else F.lit(False))
    n_only, n_all = only.count(), holdout.count()
    if n_only > targets.holdout:
        held = by_turns(only, None, "stratum", "case_id", targets.holdout, targets.holdout, f"{seed}-holdout")
    else:
        fill = min(targets.holdout, n_all) - n_only
        others = holdout.where(~F.coalesce(F.col("stratum").isin(list(targets.holdout_strata)), F.lit(False)) if targets.holdout_strata else F.lit(True))
        held = only.select("case_id").unionByName(by_turns(others, None, "stratum", "case_id", fill, fill, f"{seed}-holdout"))

    once = lambda df, phase: df.select("case_id", F.lit(phase).alias("phase"), F.lit(0).alias("rep"))
    again = repeated.select("case_id", F.lit("repeat").alias("phase"), F.explode(F.sequence(F.lit(1), F.lit(targets.repeats))).alias("rep"))
    out = once(pilot, "pilot").unionByName(once(broad, "broad")).unionByName(once(whole, "counterfactual")).unionByName(again).unionByName(once(held, "holdout"))
    for part in load:
        out = out.unionByName(part)
    return out


def _next(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of units' sizes, and for each unit, were it the first of a shard, the place of the next shard's first."""
    upto = np.cumsum(sizes)
    return upto, np.maximum(np.searchsorted(upto, upto - sizes + most, "right"), np.arange(1, len(sizes) + 1))


def steps(sizes: np.ndarray, most: int) -> Steps:
    """What units that follow each other do to how full a shard is (0 before the first of all), and the shards they begin."""
    sizes = np.asarray(sizes, np.int64)
    n, (upto, after) = len(sizes), _next(sizes, most)
    fit = upto[: np.searchsorted(upto, most, "left")]
    # the unit that begins a shard, by how full the one before it is; a fuller one leaves room for fewer
    lo, at = np.append([0, 1], most - fit[::-1] + 1), np.append([after[0], len(fit)], np.arange(len(fit))[::-1])
    last, begun, jump = np.arange(n + 1), np.append(np.ones(n, np.int64), 0), np.append(after, n)
    while (jump < n).any():  # from shard to shard, twice as far each time
        last, begun, jump = np.where(jump < n, last[jump], last), begun + begun[jump], jump[jump]
    whole = at == n  # no shard begins here
    add, count = np.where(whole, upto[-1], upto[-1] - np.append(upto - sizes, 0)[last[at]]), begun[at]
    new = np.append(True, (whole[1:] != whole[:-1]) | (add[1:] != add[:-1]) | (count[1:] != count[:-1]))
    return Steps(lo[new], whole[new].astype(np.int64), add[new], count[new])


def starts(sizes: np.ndarray, most: int, used: int) -> list[int]:
    """The places of the units that begin a shard, where the one before them is ``used`` full."""
    upto, after = _next(np.asarray(sizes, np.int64), most)
    at, out, after = int(np.searchsorted(upto, most - used, "right")) if used else int(after[0]), [], after.tolist()
    while at < len(after):
        out.append(at)
        at = after[at]
    return out


def _begun(units: DataFrame, most: int) -> DataFrame:
    """(bucket, shard, begun): of each bucket of ``units`` (unit, size, key, bucket) the shard that
    it is entered with, and the (key, unit) that begin one in it."""
    packs = units.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "unit", "size"))).alias("units"))

    @F.pandas_udf("lo binary, keep binary, add binary, counts binary")
    def function(sizes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([steps(z, most).packed() for z in sizes], columns=list(PACKED))

    @F.pandas_udf("array<int>")
    def places(sizes: pd.Series, used: pd.Series) -> pd.Series:
        return pd.Series([starts(z, most, int(u)) for z, u in zip(sizes, used)], dtype=object)

    made = packs.select(F.lit(0).alias("all"), "bucket", F.lit(0).alias("part"), function("units.size").alias("f")).select("all", "bucket", "part", "f.*")
    # a left join asks nothing of packs, so that they are shuffled once for both
    met = packs.join(entered(made, ["all"], "bucket").drop("all"), "bucket", "left").withColumn("places", places("units.size", "entered"))
    first = lambda i: F.struct(F.col("units")[i]["key"].alias("key"), F.col("units")[i]["unit"].alias("unit"))
    return kept(met.select("bucket", F.col("counted").alias("shard"), F.transform("places", first).alias("begun")))


def _placed(rows: DataFrame, begun: DataFrame, key: Column, unit: Column) -> DataFrame:
    """``rows`` (bucket, ..) with the shard of their unit."""
    met = rows.join(begun, "bucket")
    before = bound(F.struct(key.alias("key"), unit.alias("unit")), lambda me: F.size(F.filter("begun", lambda b: b <= me)))  # a key once a row
    return met.withColumn("shard", F.col("shard") + before).drop("begun")


def packed(units: DataFrame, unit: str, size: str, most: int, key: Column) -> DataFrame:
    """(unit, size, shard): units in the order of ``key``, a SHA-256 as hexadecimal text, and
    of the unit's name, each in the shard of the one before it if that then has ``most``
    at most, else in a new one; shards count from 0. A unit over ``most`` has its own. Sizes
    are 1 at least."""
    rows = units.select(unit, F.col(size).cast("long").alias("size"), key.alias("key"))
    rows = rows.withColumn("bucket", even_buckets(rows, F.col("key"), UNITS)).withColumn("key", F.unhex("key"))
    begun = _begun(rows.withColumnRenamed(unit, "unit"), most)
    return _placed(rows, begun, F.col("key"), F.col(unit)).select(unit, "size", "shard")


def remaining(cases: DataFrame, assigned: DataFrame, most: int, seed: str) -> DataFrame:
    """(case_id, shard, phase) of every case that ``assigned`` (case_id) hasn't; shards count from 1."""
    left = cases.where(F.col("split").isin("dev", "holdout")).join(assigned.select("case_id").distinct(), "case_id", "left_anti")
    held = F.col("split") == "holdout"
    unit = F.when(held, F.concat(F.lit("case-"), F.col("case_id").cast("string"))).otherwise(F.concat(F.lit("family-"), F.col("family").cast("string")))
    phase = F.when(held, "holdout").when(F.col("base").isNotNull(), "counterfactual").otherwise("broad")
    key = shuffle_key(f"{seed}-pack", F.col("unit"))
    bucket = even_buckets(cases, key, UNITS)
    units = left.select(unit.alias("unit")).groupBy("unit").agg(F.count("*").alias("size"))
    begun = _begun(units.select("unit", "size", F.unhex(key).alias("key"), bucket.alias("bucket")), most)
    # a case finds its shard by its unit's key alone: cases and units need not meet
    named = left.select("case_id", unit.alias("unit"), phase.alias("phase")).withColumn("bucket", bucket)
    return _placed(named, begun, F.unhex(key), F.col("unit")).select("case_id", (F.col("shard") + 1).alias("shard"), "phase")


def plan(cases: DataFrame, targets: Targets, most: int, seed: str) -> DataFrame:
    """(case_id, shard, phase, rep) of all shards; the core is shard 0. Load trials of a
    case don't keep it from its own place in a later shard."""
    cases = kept(cases.select("case_id", "workflow", "stratum", "family", "base", "split", "ambiguous", "repeated"))
    first = kept(core(cases, targets, seed))
    rest = remaining(cases, first.where(F.col("phase").isin("pilot", "broad", "counterfactual", "holdout")), most, seed)
    return first.select("case_id", F.lit(0).cast("long").alias("shard"), "phase", "rep").unionByName(rest.select("case_id", "shard", "phase", F.lit(0).alias("rep")))
