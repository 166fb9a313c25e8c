"""Exact percentiles of groups of any size, by selection over refined histograms.

The value at a rank is looked for in rounds. A round counts the values of the open
intervals over BUCKETS equal parts, which tasks do by themselves before anything
travels; running counts tell the part that holds the rank, and the part's own least and
largest values are the next interval. A part that holds few values, or one, ends the
search. So no task ever holds a group's values, nor its distinct ones, and a group
of a hundred billion needs some five rounds.

Values are compared as doubles; NaN is above all others, and infinities are the
parts at the ends. Nulls don't count; a group without values has null results. The rank is
that of the nearest-rank rule, ceil(q * n), 1 at least.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.sources.shared import kept

#: Parts of an interval, and values of a part that are sorted together at most.
BUCKETS, FEW = 2_048, 20_000


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """The part of [lo, hi] that a value is in; it never falls where values grow."""
    # halves where the width would overflow; else not, as the least numbers have no halves
    even = F.when((F.abs(lo) > 1e300) | (F.abs(hi) > 1e300), F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)).otherwise(F.try_divide(v - lo, hi - lo))
    # an interval of several powers of ten, or of both signs, is parted by them first
    power = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + 746))
    steep = ((lo <= 0) & (hi >= 0)) | (F.abs(hi) / 8 > F.abs(lo)) | (F.abs(lo) / 8 > F.abs(hi))
    share = F.coalesce(F.when(steep, F.try_divide(power(v) - power(lo), power(hi) - power(lo))), even)
    inside = F.floor(share * BUCKETS).cast("int")
    return F.when(F.isnan(v), BUCKETS + 1).when(v == float("inf"), BUCKETS).when(v == float("-inf"), -1).when(lo == hi, 0).otherwise(F.greatest(F.lit(0), F.least(inside, F.lit(BUCKETS - 1))))


def percentiles(rows: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """(keys, q, n, at): the value ``at`` rank ceil(q * n) of each group."""
    k = [f"k{i}" for i in range(len(keys))]
    values = rows.select(*(F.col(c).alias(a) for c, a in zip(keys, k)), F.col(value).cast("double").alias("v")).where("v is not null")
    facts = values.groupBy(*k).agg(F.count("*").alias("n"), F.min(F.when(_finite(F.col("v")), F.col("v"))).alias("lo"), F.max(F.when(_finite(F.col("v")), F.col("v"))).alias("hi"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long")
    # at first an interval holds all values, those that are not finite too
    aims = kept(facts.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs)))).select(*k, "q", "n", rank.alias("rank"), F.col("n").alias("size"), F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi"), F.lit(True).alias("all")))
    done, large = None, F.col("size") > FEW
    while not (open_ := aims.where(large)).isEmpty():
        intervals = open_.select(*(F.col(c).alias(f"of_{c}") for c in k), "lo", "hi", "all").distinct()
        met = values.join(intervals, _same(k, [f"of_{c}" for c in k]) & (F.col("all") | F.col("v").between(F.col("lo"), F.col("hi"))))
        counts = met.groupBy(*k, "lo", "hi", "all", _part(F.col("v"), F.col("lo"), F.col("hi")).alias("part")).agg(F.count("*").alias("here"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("here").over(Window.partitionBy(*k, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before).select(*(F.col(c).alias(f"of_{c}") for c in k), F.col("lo").alias("of_lo"), F.col("hi").alias("of_hi"), "here", "least", "most", "before")
        inside = _same([*k, "lo", "hi"], [f"of_{c}" for c in [*k, "lo", "hi"]]) & (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("here"))
        next_ = open_.join(counts, inside).select(*k, "q", "n", (F.col("rank") - F.col("before")).alias("rank"), F.col("here").alias("size"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.lit(False).alias("all"))
        both = kept(next_.unionByName(aims.where(~large)))
        found = both.where("not all and lo <=> hi").select(*k, "q", "n", F.col("lo").alias("at"))
        done = found if done is None else done.unionByName(found)
        aims = both.where("all or not lo <=> hi")
    intervals = aims.select(*(F.col(c).alias(f"of_{c}") for c in k), "lo", "hi", "all").distinct()
    met = values.join(intervals, _same(k, [f"of_{c}" for c in k]) & (F.col("all") | F.col("v").between(F.col("lo"), F.col("hi"))))
    placed = met.withColumn("rn", F.row_number().over(Window.partitionBy(*k, "lo", "hi").orderBy("v"))).select(*(F.col(c).alias(f"in_{c}") for c in k), F.col("lo").alias("in_lo"), F.col("hi").alias("in_hi"), "v", "rn")
    few = aims.join(placed, _same([*k, "lo", "hi"], [f"in_{c}" for c in [*k, "lo", "hi"]]) & (F.col("rank") == F.col("rn"))).select(*k, "q", "n", F.col("v").alias("at"))
    out = few if done is None else few.unionByName(done)
    return out.select(*(F.col(a).alias(c) for c, a in zip(keys, k)), "q", "n", "at")
