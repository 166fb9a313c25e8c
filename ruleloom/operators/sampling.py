"""Deterministic sampling and planning: order comes from SHA-256 of a seed and
the id, so that a plan is the same on every run and cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.sources.shared import kept


def shuffle_key(seed: str, *ids: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *(i.cast("string") for i in ids)), 256)


def carried(rows: DataFrame, keys: list[str], order: list, bucket: Column, how: str, value: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum or maximum of ``value`` over all rows before a
    row in its group; null where there is none.

    ``bucket`` grows with ``order``, so that a group is looked at bucket by bucket:
    no task sorts more than a bucket, and a row for each bucket tells what the
    ones before it come to."""
    agg = {"sum": F.sum, "max": F.max}[how]
    b, local, earlier = f"{out}_bucket", f"{out}_local", f"{out}_earlier"
    marked = rows.withColumn(b, bucket)
    first = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = marked.groupBy(*keys, b).agg(agg(value).alias("part"))
    before = parts.select(*(F.col(k).alias(f"{out}_{k}") for k in [*keys, b]), agg("part").over(first(Window.partitionBy(*keys).orderBy(b))).alias(earlier))
    here = marked.withColumn(local, agg(value).over(first(Window.partitionBy(*keys, b).orderBy(*order))))
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{out}_{k}")) for k in [*keys, b]])
    both = F.coalesce(F.col(local) + F.col(earlier), local, earlier) if how == "sum" else F.greatest(local, earlier)
    return here.join(before, met).withColumn(out, both).select(*rows.columns, out)


def ranked(rows: DataFrame, keys: list[str], order: list, bucket: Column, rn: str = "rn", total: str | None = None) -> DataFrame:
    """``rows`` with ``rn``, their place by ``order`` in their group from 1, and with
    ``total``, the group's rows; bucket by bucket as in ``carried``."""
    out = carried(rows, keys, order, bucket, "sum", F.lit(1), rn).withColumn(rn, (F.coalesce(rn, F.lit(0)) + 1).cast("int"))
    if total is None:
        return out
    counts = rows.groupBy(*(F.col(k).alias(f"{total}_{k}") for k in keys)).agg(F.count("*").alias(total))
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{total}_{k}")) for k in keys])
    return out.join(counts, met).select(*out.columns, total)


def hash_bucket(key: Column) -> Column:
    """Of a shuffle key, one of 4,096 parts in its order."""
    return F.substring(key, 1, 3)


def foremost(rows: DataFrame, groups: list[str], key: Column, n: int) -> DataFrame:
    """``rows`` without most of those that are not among the first ``n`` of their group by
    ``key``, a SHA-256 as hexadecimal text, so that a large group needn't be sorted for a few rows.

    A group's size tells up to where its first 2 n + 64 keys should reach. Where fewer than n
    came, which hardly happens, the whole group is taken. A row for each group is broadcast."""
    named = [F.col(g).alias(f"of_{g}") for g in groups]
    met = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups])
    sizes = kept(rows.groupBy(*named).agg(F.count("*").alias("of_size")))
    upto = F.least(F.lit(float(2**32)), F.lit(2.0**32 * (2 * n + 64)) / F.col("of_size"))
    near = kept(rows.join(F.broadcast(sizes), met).where(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") < upto).select(*rows.columns))
    here = near.groupBy(*groups).agg(F.count("*").alias("here"))
    short = sizes.join(here, met, "left").where(F.coalesce("here", F.lit(0)) < F.least(F.col("of_size"), F.lit(n))).select(*(f"of_{g}" for g in groups))
    if short.isEmpty():
        return near
    return near.join(F.broadcast(short), met, "left_anti").unionByName(rows.join(F.broadcast(short), met, "left_semi"))


def medians(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Three medians of values that are counted: at rank ceil(n / 2) (nearest), the
    mean of the middle two (middle), and at place n // 2 from 0 (upper). Windows run
    over the distinct values of a group."""
    upto = F.sum(n).over(Window.partitionBy(*keys).orderBy(value))
    placed = counts.withColumn("upto", upto).withColumn("all", F.sum(n).over(Window.partitionBy(*keys)))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(value)))
    low, high = F.expr("(all + 1) div 2"), F.expr("all div 2 + 1")
    return placed.groupBy(*keys).agg(at(low).alias("nearest"), ((at(low) + at(high)) / 2).alias("middle"), at(high).alias("upper"))


def top_per_group(rows: DataFrame, group: str, key: Column, n: int) -> DataFrame:
    """The first ``n`` of each group by ``key``; tasks keep n of a group each before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("rn") <= n)


def round_robin(rows: DataFrame, stratum: str, id_: str, n: int, seed: str) -> DataFrame:
    """``n`` rows, one from each stratum in turn: no stratum needs more than n,
    so at most n rows of each are sorted together."""
    first = top_per_group(rows, stratum, shuffle_key(seed, F.col(id_)), n)
    return first.orderBy("rn", shuffle_key(seed, F.col(stratum)), stratum).limit(n)


def proportional(rows: DataFrame, stratum: str, id_: str, n: int, seed: str, near: DataFrame | None = None) -> DataFrame:
    """``n`` rows in proportion to strata; largest remainders get what rounding leaves.
    ``near`` are rows among which each stratum's first ``n`` are known to be."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    every = Window.partitionBy(F.lit(1))  # over one row for each stratum
    exact = sizes.withColumn("total", F.sum("size").over(every)).withColumn("floor", F.expr(f"size * {n} div total")).withColumn("rest", F.expr(f"size * {n} % total"))
    short = F.lit(n) - F.sum("floor").over(every)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), stratum))
    quota = exact.withColumn("quota", F.col("floor") + F.when(place <= short, 1).otherwise(0)).select(stratum, "quota")
    # no stratum gives more than n rows: a task keeps n of each
    key = shuffle_key(seed, F.col(id_))
    first = top_per_group(rows if near is None else near, stratum, key, n)
    return first.join(quota.withColumnRenamed(stratum, "of_stratum"), F.col(stratum).eqNullSafe(F.col("of_stratum"))).where("rn <= quota").select(*rows.columns)


def balanced(rows: DataFrame, group: str, id_: str, levels: int, seed: str) -> DataFrame:
    """Levels dealt in turn within each group: their counts differ by one at most."""
    key = shuffle_key(seed, F.col(id_))
    placed = ranked(rows, [group], [key], hash_bucket(key), "level")
    return placed.withColumn("level", ((F.col("level") - 1) % levels).cast("int"))


def hash_mod20(x: Column) -> Column:
    """The SHA-256 of a text mod 20, without big integers: 16 to any power from
    1 on is 16 mod 20."""
    digits = F.transform(F.split(F.sha2(x, 256), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    last = F.element_at(digits, -1)
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + d)
    return ((last + 16 * (total - last)) % 20).cast("int")


def grouped_split(rows: DataFrame, stratum: str, family: str, share: float, seed: str) -> DataFrame:
    """Whole families to validation until their rows reach ``share`` of the
    stratum; the family that crosses the share is the last."""
    fam = rows.groupBy(stratum, family).agg(F.count("*").alias("n"))
    key = shuffle_key(seed, F.col(family))
    placed = carried(fam, [stratum], [key, family], hash_bucket(key), "sum", F.col("n"), "before")
    total = rows.groupBy(F.col(stratum).alias("of_stratum")).agg(F.count("*").alias("total"))
    return placed.join(total, F.col(stratum).eqNullSafe(F.col("of_stratum"))).select(stratum, family, "n", F.when(F.coalesce("before", F.lit(0)) < share * F.col("total"), "validation").otherwise("train").alias("split"))


def plan(cases: DataFrame, id_: str, phase: Column, reps: Column, seed: str) -> DataFrame:
    """(trial_id, case, phase, rep, arm_order): cases times repetitions, arms in an order that a coin decides."""
    each = cases.select(F.col(id_).alias("case_id"), phase.alias("phase"), F.explode(reps).alias("rep"))
    trial = F.concat_ws("#", F.col("case_id").cast("string"), "phase", F.concat(F.lit("r"), F.col("rep").cast("string")))
    coin = F.substring(shuffle_key(seed, trial), 1, 1) < "8"
    return each.select(trial.alias("trial_id"), "case_id", "phase", "rep", F.when(coin, "first,second").otherwise("second,first").alias("arm_order"))


def edits(rows: DataFrame, id_: str, applicable: list[tuple[str, Column, Column]], most: int, seed: str) -> DataFrame:
    """One-fact edits (name, applicable, new value): of each row's applicable
    ones, at most ``most`` in shuffled order."""
    options = F.array(*(F.when(ok, F.struct(F.lit(name).alias("edit"), value.cast("string").alias("value"))) for name, ok, value in applicable))
    each = F.transform(F.array_compact(options), lambda o: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_).cast("string"), o["edit"]), 256).alias("k"), o["edit"].alias("edit"), o["value"].alias("value")))
    return rows.select(id_, F.explode(F.slice(F.array_sort(each), 1, most)).alias("e")).select(id_, "e.edit", "e.value")
