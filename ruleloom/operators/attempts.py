"""Chains of attempts: what each attempt came to, and whether the chain kept the rules of retrying."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that stop a run, how often an attempt is repeated, and the seconds before each repetition.
FATAL = [401, 402, 403, 404]
RETRIES, WAITS, JITTER = 2, [1.0, 4.0], 0.25


def outcome_class(status: Column, error: Column) -> Column:
    """What an attempt came to: ``ok``, ``retryable`` (too many requests, a server's
    error, no connection, no answer in time), ``fatal`` (the run must stop),
    ``aborted`` or ``final`` (any other refusal, a body that can't be read).

    Without a status the error decides; without either the attempt is aborted."""
    why = F.coalesce(error, F.lit(""))
    lost = (why == "timeout") | why.startswith("network_error")
    return (F.when(why == "aborted", "aborted").when((status == 429) | (status >= 500) | (status.isNull() & lost), "retryable")
            .when(status.isin(FATAL), "fatal").when(status.isNull() & (why == ""), "aborted").when(status.between(200, 299) & (why == ""), "ok").otherwise("final"))


def chains(attempts: DataFrame, keys: list[str], number: str, kind: Column, begin_us: str, end_us: str, slack_s: float = 0.5, retries: int = RETRIES, waits: list[float] = WAITS, jitter_s: float = JITTER) -> DataFrame:
    """(keys, attempts, last_number, outcome, repeated, gaps, unasked, beyond, early, late, sound):
    a row for each chain, numbered from 1 by ``number``; ``kind`` as of ``outcome_class``.

    ``outcome`` is the last attempt's class, or ``exhausted`` where that may be
    retried and no retry is left, ``cut_short`` where one was. Counted are numbers
    that occur again, attempts without the one before them, those after one that
    was not to be retried, those beyond the last retry, and retries that begin
    earlier than their wait or later than wait, jitter and slack.

    The earliest of attempts with one number stands for them; a missing number is
    0, which is a gap. Null keys are a key. An attempt meets the one before it by
    number, so a chain of any length is spread over tasks, and no order is sorted."""
    one = attempts.select(*keys, F.coalesce(F.col(number).cast("long"), F.lit(0)).alias("no"), F.col(begin_us).cast("long").alias("b"), F.col(end_us).cast("long").alias("e"), kind.alias("kind"))
    links = one.groupBy(*keys, "no").agg(F.count("*").alias("copies"), F.min(F.struct("b", "e", "kind")).alias("a"))
    before = links.select(*(F.col(k).alias(f"{k}_before") for k in keys), (F.col("no") + 1).alias("no_before"), F.col("a").alias("p"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_before")) for k in keys], F.col("no") == F.col("no_before"))
    met = links.join(before, same, "left")
    wait = (F.col("a.b") - F.col("p.e")) / 1e6
    due = F.try_element_at(F.array(*map(F.lit, waits)), (F.col("no") - 1).cast("int"))
    retried = (F.col("no") > 1) & F.col("p").isNotNull()
    ordered = F.when(F.col("no") > 1, due)  # position 0 is no element
    marks = {"gaps": (F.col("no") < 1) | ((F.col("no") > 1) & F.col("p").isNull()), "unasked": retried & (F.col("p.kind") != "retryable"), "beyond": F.col("no") > retries + 1,
             "early": retried & (wait < ordered), "late": retried & (wait > ordered + jitter_s + slack_s)}
    agg = met.groupBy(*keys).agg(F.sum("copies").alias("attempts"), F.max("no").alias("last_number"), F.max_by("a", "no")["kind"].alias("last"), F.count_if(F.col("copies") > 1).alias("repeated"),
                                 *(F.count_if(F.coalesce(m, F.lit(False))).alias(n) for n, m in marks.items()))
    outcome = F.when(F.col("last") != "retryable", F.col("last")).when(F.col("last_number") > retries, "exhausted").otherwise("cut_short")
    faults = ["repeated", *marks]
    return agg.select(*keys, "attempts", "last_number", outcome.alias("outcome"), *faults, (reduce(lambda x, y: x + y, map(F.col, faults)) == 0).alias("sound"))


def after_fatal(attempts: DataFrame, segment: str, kind: Column, begin_us: str, end_us: str, grace_s: float = 2.0) -> DataFrame:
    """Attempts that began more than ``grace_s`` after their segment's first fatal
    attempt had ended: a fatal status stops the whole segment. One row a segment
    meets the attempts; those of a null segment are one segment."""
    first = attempts.where(kind == "fatal").groupBy(F.col(segment).alias("of_segment")).agg(F.min(end_us).alias("stopped_us"))
    met = attempts.join(first, F.col(segment).eqNullSafe(F.col("of_segment")))
    return met.where(F.col(begin_us) > F.col("stopped_us") + int(grace_s * 1e6)).select(*attempts.columns, "stopped_us")
