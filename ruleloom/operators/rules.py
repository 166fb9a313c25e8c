"""Ordered rules: the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[str, Column, Column | str]], default: tuple[str, Column | str] | Column) -> Column:
    """struct(choice, reason) of the first rule (reason, condition, choice) that
    holds. A null condition does not hold. ``default`` is one more outcome, or a Column
    of such. One CASE: branches after the first
    match aren't evaluated."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    outcome = lambda reason, choice: F.struct(lit(choice).alias("choice"), F.lit(reason).alias("reason"))
    chain = None
    for reason, condition, choice in rules:
        chain = F.when(condition, outcome(reason, choice)) if chain is None else chain.when(condition, outcome(reason, choice))
    end = default if isinstance(default, Column) else outcome(*default)
    return end if chain is None else chain.otherwise(end)


def offered(choice: Column, options: Column, abstain: Column) -> Column:
    """The choice if it is among the options; else the abstain key if that is; else null."""
    return F.when(F.array_contains(options, choice), choice).when(F.array_contains(options, abstain), abstain)


def flags(choice: Column, valid: Column, expected: Column, abstain: Column) -> tuple[Column, Column]:
    """(abstained, correct): both need a valid answer, neither is ever null."""
    return F.coalesce(valid & (choice == abstain), F.lit(False)), F.coalesce(valid & (choice == expected), F.lit(False))
