"""Shards, quotas, noise, guards and nested look-ups for building and checking runs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions.text import bound
from ruleloom.operators.sampling import hash_bucket, ranked, shuffle_key


def arms(results: DataFrame, trial: str, arm: str, names: list[str], value: str) -> DataFrame:
    """One row for each trial that all of ``names`` answered, a column for each."""
    wide = results.where(F.col(arm).isin(names)).groupBy(trial).pivot(arm, names).agg(F.first(value, ignorenulls=True))
    for n in names:
        wide = wide.where(F.col(n).isNotNull())
    return wide


def core_shard(cases: DataFrame, id_: str, family: str, base: str, holdout: Column, n_families: int, n_holdout: int, seed: str) -> DataFrame:
    """(id, phase): whole families that have siblings, in shuffled order, and holdout cases.

    ``base`` is null for a family's first member. Families are cut by a rank over
    family keys alone, cases follow by a join."""
    fam = cases.groupBy(family).agg(F.count_if(F.col(base).isNotNull()).alias("siblings")).where("siblings > 0")
    picked = fam.orderBy(shuffle_key(seed, F.col(family)), family).limit(n_families).select(family)
    whole = cases.join(picked, family).select(id_, F.lit("counterfactual").alias("phase"))
    held = cases.where(holdout).orderBy(shuffle_key(seed, F.col(id_)), id_).limit(n_holdout).select(id_, F.lit("holdout").alias("phase"))
    return whole.unionByName(held)


def phases(cases: DataFrame, id_: str, stratum: str, quotas: list[tuple[str, Column, int | None, int]], seed: str) -> DataFrame:
    """(id, phase, rep): the phases of a shard in order. Each takes up to n cases
    of each stratum (all where n is null) that fit it and that no phase before has
    taken, in shuffled order, and plans them ``reps`` times.

    Phases pick one after the other: each takes, of the cases that fit it and that no
    earlier phase has picked, the first n of each stratum in hash order, so what a
    full phase leaves goes on to the next that it fits; n is null for all. Earlier
    phases pick as many of a stratum as their quotas say at most, and so a phase's
    picks are among as many more of its first cases: only these meet in a task."""
    key = shuffle_key(seed, F.col(id_))
    limited = [i for i, q in enumerate(quotas) if q[2] is not None]
    most = {i: sum(quotas[j][2] for j in limited if j <= i) for i in limited}
    # a phase without a quota takes all that earlier ones leave, so later ones don't see what fits it
    whole_before = {i: reduce(lambda x, y: x | y, [F.coalesce(quotas[j][1], F.lit(False)) for j in range(i) if quotas[j][2] is None], F.lit(False)) for i in range(len(quotas))}
    fits = F.array(*(F.coalesce(q[1], F.lit(False)) & ~whole_before[i] for i, q in enumerate(quotas)))
    able = cases.select(id_, stratum, key.alias("key"), fits.alias("fits"))
    each = able.withColumn("of", F.explode(F.array_compact(F.array(*(F.when(F.col("fits")[i], i) for i in limited), F.lit(None).cast("int")))))
    rn = F.row_number().over(Window.partitionBy(stratum, "of").orderBy("key", id_))
    near = each.withColumn("rn", rn).where(F.col("rn") <= max(most.values(), default=0))
    near = near.where(F.col("rn") <= F.element_at(F.create_map(*(F.lit(x) for i in most for x in (i, most[i]))), F.col("of"))) if most else near
    picked = near.groupBy(id_, stratum, "key").agg(F.first("fits").alias("fits")).withColumn("phase", F.lit(None).cast("int"))
    upto = Window.partitionBy(stratum).orderBy("key", id_).rowsBetween(Window.unboundedPreceding, 0)
    for i in limited:
        free = F.col("phase").isNull() & F.col("fits")[i]
        picked = picked.withColumn("free", free).withColumn("so_far", F.sum(F.col("free").cast("int")).over(upto))
        picked = picked.withColumn("phase", F.when(F.col("free") & (F.col("so_far") <= quotas[i][2]), i).otherwise(F.col("phase")))
    done = picked.where("phase is not null").select(id_, "phase")
    without = [i for i, q in enumerate(quotas) if q[2] is None]
    if without:
        first = F.coalesce(*(F.when(F.col("fits")[i], i) for i in without))
        left = able.join(done.select(F.col(id_).alias("done_id")), F.col(id_) == F.col("done_id"), "left_anti")
        done = done.unionByName(left.select(id_, first.alias("phase")).where("phase is not null"))
    names, reps = F.array(*(F.lit(q[0]) for q in quotas)), F.array(*(F.lit(q[3]) for q in quotas))
    return done.select(id_, names[F.col("phase")].alias("phase"), F.explode(F.sequence(F.lit(1), reps[F.col("phase")])).alias("rep"))


def load_samples(cases: DataFrame, id_: str, levels: list[int], n: int, first_rep: int, seed: str) -> DataFrame:
    """(id, phase, rep): for each level of concurrency the same n cases again, as
    repetitions of their own numbers, so that no load trial is a main trial."""
    chosen = cases.orderBy(shuffle_key(seed, F.col(id_)), id_).limit(n)
    each = F.explode(F.array(*(F.struct(F.lit(f"load_c{c}").alias("phase"), F.lit(first_rep + i).alias("rep")) for i, c in enumerate(levels)))).alias("l")
    return chosen.select(id_, each).select(id_, "l.phase", "l.rep")


def option_subset(required: Column, confusers: Column, others: Column, canonical: Column, size: int, key: str, id_: Column) -> Column:
    """``size`` options: the required ones, then confusers, then others, each kind
    in shuffled order, and all at last in the canonical order."""
    shuffled = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(F.sha2(F.concat_ws("|", F.lit(key), id_.cast("string"), x), 256).alias("k"), x.alias("x")))), lambda s: s["x"])
    chosen = F.slice(F.array_union(F.array_union(required, shuffled(confusers)), shuffled(others)), 1, size)
    return bound(chosen, lambda c: F.filter(canonical, lambda o: F.array_contains(c, o)))  # chosen once, not for each option


def length_batches(rows: DataFrame, id_: str, length: Column, most: int, budget: int, width: int) -> DataFrame:
    """``rows`` with batch: rows of about one length together, so many that the
    square of the longest length times their number stays within ``budget``.

    A bucket is ``width`` lengths; in it, rows are dealt by hash over as many
    batches as its longest asks for. Lengths over ``most`` count as that."""
    top = F.least(F.ceil(length / width) * width, F.lit(most)).cast("long")
    counts = rows.groupBy(top.alias("top")).agg(F.count("*").alias("rows_of"))
    each = F.greatest(F.expr(f"{budget} div (top * top)"), F.lit(1))
    batches = counts.select("top", F.ceil(F.col("rows_of") / each).cast("int").alias("batches"), each.cast("int").alias("each"))
    placed = ranked(rows.withColumn("top", top), ["top"], [shuffle_key("batch", F.col(id_)), id_], hash_bucket(shuffle_key("batch", F.col(id_))), "rn")
    return placed.join(batches, "top").withColumn("batch", F.concat_ws("-", "top", F.expr("(rn - 1) div each"))).select(*rows.columns, "batch")


def label_quota(rows: DataFrame, group: str, id_: str, label: Column, share: float, seed: str) -> DataFrame:
    """Rows so that ``label`` holds for about ``share`` of each group: as many of
    the other rows are kept as the rarer side allows, in shuffled order."""
    key = shuffle_key(seed, F.col(id_))
    counts = rows.groupBy(F.col(group).alias("of_group")).agg(F.count_if(label).alias("n_on"), F.count_if(~label).alias("n_off"))
    want_on = F.least(F.col("n_on"), F.floor(F.col("n_off") * share / (1 - share)))
    want_off = F.least(F.col("n_off"), F.floor(F.col("n_on") * (1 - share) / share))
    placed = ranked(rows.withColumn("on", label), [group, "on"], [key, id_], hash_bucket(key))
    met = placed.join(counts, F.col(group).eqNullSafe(F.col("of_group")))
    return met.where(F.col("rn") <= F.when(F.col("on"), want_on).otherwise(want_off)).select(*rows.columns)


def swap_noise(text: Column, seed: str, id_: Column, least: int = 7, one_in: int = 4) -> Column:
    """Neighbouring letters swapped inside some long lower-case words. The coin
    and the place come from a hash of seed, id and word, so a rerun gives the same text."""

    def one(w: Column, i: Column) -> Column:
        h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), id_.cast("string"), i.cast("string"), w), 256), 1, 7), 16, 10).cast("int")
        n = F.length(w)
        k = F.pmod(F.floor(h / one_in).cast("int"), F.greatest(n - 3, F.lit(1))) + 2
        at = lambda p, m: F.substring(w, p, m)
        swapped = F.concat(at(F.lit(1), k - 1), at(k + 1, F.lit(1)), at(k, F.lit(1)), at(k + 2, n))
        return F.when((n >= least) & w.rlike("^[a-z]+$") & (h % one_in == 0), swapped).otherwise(w)

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def fillers(rows: DataFrame, pool: DataFrame, id_: str, block: str, value: str, n: int, seed: str) -> DataFrame:
    """(id, value): ``n`` pool values for each row, of its own block, that differ
    from its own value. Rows and pool meet on the block and a slice of the pool's
    hash order that follows from the row, so that a row meets a few values only."""
    key = shuffle_key(seed, F.col(value))
    placed = ranked(pool.select(block, value).distinct(), [block], [key, value], hash_bucket(key), "place").withColumn("place", F.col("place") - 1)
    sizes = placed.groupBy(block).agg(F.count("*").cast("int").alias("size"))
    wanted = rows.join(sizes, block).select(id_, block, F.col(value).alias("own"), F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("size") - 1))).alias("step"), F.pmod(F.hash(id_), F.col("size")).alias("start"), "size")
    wanted = wanted.withColumn("place", F.pmod(F.col("start") + F.col("step"), F.col("size")))
    met = wanted.join(placed, [block, "place"]).where(F.col(value) != F.col("own"))
    rn = F.row_number().over(Window.partitionBy(id_).orderBy("step"))
    return met.withColumn("rn", rn).where(F.col("rn") <= n).select(id_, value)


def within_deadline(t: Column, deadline: Column, margin_s: float) -> Column:
    """Whether an attempt may still begin."""
    return F.unix_millis(t.cast("timestamp")) + F.lit(int(margin_s * 1000)) <= F.unix_millis(deadline.cast("timestamp"))


def guard(inputs: dict[str, DataFrame]) -> DataFrame:
    """(name, digest) of tables, whatever the order of their rows: a resumed run
    compares these with those that it began with. Partial sums, one row a table."""
    out = None
    for name, df in inputs.items():
        row = F.sha2(F.to_json(F.struct(*df.columns)), 256)
        parts = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
        one = df.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("digest")).select(F.lit(name).alias("name"), "digest")
        out = one if out is None else out.unionByName(one)
    return out


def _find(key: str):
    def one(text: str | None) -> str | None:
        try:
            level = [json.loads(text)] if text is not None else []
        except ValueError:
            return None
        while level:
            below = []
            for x in level:
                if isinstance(x, dict):
                    if key in x:
                        return json.dumps(x[key], ensure_ascii=False, separators=(",", ":"))
                    below += x.values()
                elif isinstance(x, list):
                    below += x
            level = below
        return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one, na_action=None)

    return run


def nested_value(text: Column | str, key: str) -> Column:
    """The value (as JSON) of the shallowest ``key`` anywhere in a JSON text.
    Depth isn't bounded, which built-in paths can't say."""
    return F.pandas_udf(_find(key), "string")(text)
