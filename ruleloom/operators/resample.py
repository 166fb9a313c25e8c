"""Bootstrap intervals and greedy shards: the steps that need imperative code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bootstrap(rows: DataFrame, group: str, counts: list[str], statistic, resamples: int = 2_000, seed: int = 7, upper_offset: int = 0) -> DataFrame:
    """(group, value, low, high). Outcomes are counted by value first, so that a
    group is a few counts whatever its size, and each resample is one
    multinomial draw of them.

    ``counts`` are columns of indicator values; ``statistic`` maps an array of
    resampled counts (resamples x values) and the values to one number each."""
    table = rows.groupBy(group, *counts).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values, n = pdf[counts].to_numpy(float), pdf["n"].to_numpy(np.int64)
        order = np.lexsort(values.T)
        values, n = values[order], n[order]
        total = int(n.sum())
        draws = np.random.default_rng(seed).multinomial(total, n / total, resamples)
        stats = np.sort(statistic(draws, values))
        at = lambda q, off=0: float(stats[min(resamples - 1, int(q * resamples) + off)])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "value": [float(statistic(n[None, :], values)[0])], "low": [at(0.025)], "high": [at(0.975, upper_offset)]})

    kind = rows.schema[group].dataType.simpleString()
    return table.groupBy(group).applyInPandas(run, f"{group} {kind}, value double, low double, high double")


def mean_statistic(draws: np.ndarray, values: np.ndarray) -> np.ndarray:
    return draws @ values[:, 0] / draws.sum(1)


def difference_statistic(draws: np.ndarray, values: np.ndarray) -> np.ndarray:
    return draws @ (values[:, 0] - values[:, 1]) / draws.sum(1)


#: Families of a block, about, and blocks at least.
FAMILIES, BLOCKS = 4_096, 16


def greedy_shards(families: DataFrame, family: str, size: str, most: int, seed_key: Column) -> DataFrame:
    """(family, shard, size): whole families into shards of at most ``most`` rows, in
    the order of ``seed_key``, a hash as hexadecimal text. Families are dealt over
    blocks by that hash, as many as their number asks for, and each block is packed
    by itself; a block's last shard may be short."""
    blocks = max(BLOCKS, -(-families.count() // FAMILIES))
    keyed = families.select(family, F.col(size).cast("long").alias("size"), seed_key.alias("key"))
    dealt = keyed.withColumn("block", F.conv(F.substring("key", 1, 7), 16, 10).cast("long") % blocks)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", family])
        shard, used, out = 0, 0, []
        for n in pdf["size"]:
            if used and used + n > most:
                shard, used = shard + 1, 0
            used += n
            out.append(shard)
        return pd.DataFrame({family: pdf[family], "shard": [f"b{int(b)}-s{s}" for b, s in zip(pdf["block"], out)], "size": pdf["size"]})

    kind = families.schema[family].dataType.simpleString()
    return dealt.groupBy("block").applyInPandas(run, f"{family} {kind}, shard string, size long")
