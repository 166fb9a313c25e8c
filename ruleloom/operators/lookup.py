"""Joins that look values up: foreign keys, fallbacks, coverage, cross-run hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_default(rows: DataFrame, attributes: DataFrame, key: str, columns: list[str], default: str = "?") -> DataFrame:
    """Attributes of each row's key; a row without any reads the default."""
    joined = rows.join(attributes.select(key, *columns), key, "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c) for c in columns))


def fallback(rows: DataFrame, pool: DataFrame, id_: str, keys: list[Column], key: str, value: str, universal: str | None = None) -> DataFrame:
    """``rows`` with ``value`` of the first of several keys that the pool has, else
    of the key ``universal``, which no row asks for: it is one row of the pool.

    ``id_`` tells rows apart. Each asks once for each key, with the key's place;
    the least place wins."""
    asked = rows.select(id_, F.posexplode(F.array(*keys)).alias("place", key))
    best = asked.join(pool.select(key, value), key).groupBy(id_).agg(F.min_by(value, F.struct("place", value)).alias(value))
    joined = rows.join(best, id_, "left")
    if universal is None:
        return joined
    of_all = pool.where(F.col(key) == universal).agg(F.min(value)).first()[0]
    return joined.withColumn(value, F.coalesce(value, F.lit(of_all)))


def coverage(cases: DataFrame, trials: DataFrame, key: str) -> DataFrame:
    """Cases that don't have exactly one trial, with how many they have."""
    n = trials.groupBy(key).agg(F.count("*").alias("n"))
    return cases.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("n <> 1")


def foreign_keys(rows: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(reference, n_dangling): rows whose key a referenced table lacks."""
    parts = [rows.select(F.col(c).alias("k")).where("k is not null").join(t.select(F.col(k).alias("k")).distinct(), "k", "left_anti").agg(F.lit(c).alias("reference"), F.count("*").alias("n_dangling")) for c, (t, k) in references.items()]
    return reduce(DataFrame.unionByName, parts)


def hash_changes(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys of both runs whose digests differ."""
    other = b.select(key, F.col(digest).alias("other"))
    return a.select(key, digest).join(other, key).where(~F.col(digest).eqNullSafe(F.col("other"))).select(key)
