"""Edits of cases that must not change their label, and destinations that a case could be mistaken for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.operators import policies as P
from ruleloom.sources.shared import kept


def label_kept(rows: DataFrame, before: str, after: str, parse: Callable[[Column], Column], rules: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with label_before, label_after and ``kept``: whether an edit of the
    evidence leaves the decision's choice as it was. Two nulls are one label. Each
    side is parsed and decided once for each row."""
    one = P.decided(rows, before, parse, rules).withColumn("label_before", F.col("decision.choice")).drop("decision")
    two = P.decided(one, after, parse, rules).withColumn("label_after", F.col("decision.choice")).drop("decision")
    return two.withColumn("kept", F.col("label_before").eqNullSafe(F.col("label_after")))


def safe_additions(cases: DataFrame, id_: str, evidence: str, additions: DataFrame, n: int, add: Callable[[Column, Column], Column], parse: Callable[[Column], Column], rules: Callable[[Column], Column],
                   part: Callable[[Column], Column] | None = None, joined: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id, tried, refused, added, evidence, kept): each case with the first ``n`` of
    its ``additions`` (id, place, addition) that leave its label alone, one by one.

    ``add(evidence, list)`` gives the evidence with a list of additions. Where ``part(addition)`` tells what
    ``parse`` makes of an addition, and ``joined(parsed, parts)`` puts such parts into a case's fields, a case and
    an addition are parsed once each, not once more for every pair of them and for what is kept. All else is as
    in ``safe_parts``."""
    before = cases.select(id_, F.col(evidence).alias("before"))
    if part is not None and joined is not None:
        told = safe_parts(before.withColumn("fields", parse(F.col("before"))), id_, additions.withColumn("part", part(F.col("addition"))), n, lambda f, p: p, joined, rules)
    else:
        told = safe_parts(before.withColumn("fields", F.col("before")), id_, additions.withColumn("part", F.col("addition")), n, lambda f, p: p, add, rules, parse)
    grown = F.when(F.size("added") > 0, add(F.col("before"), F.col("added"))).otherwise(F.col("before"))
    return told.select(id_, "tried", "refused", "added", grown.alias("evidence"), "label_before", "kept")


def safe_parts(cases: DataFrame, id_: str, additions: DataFrame, n: int, seen: Callable[[Column, Column], Column], joined: Callable[[Column, Column], Column], rules: Callable[[Column], Column],
               parse: Callable[[Column], Column] = lambda fields: fields) -> DataFrame:
    """``cases`` (id, fields, ...) with tried, refused, added, label_before, kept: the first ``n`` of a case's
    ``additions`` (id, place, addition, part) that leave its label alone, one by one.

    ``part`` is an addition as it was parsed, perhaps for many cases at once; ``seen(fields, part)`` what the
    rules read of it beside a case, and ``joined(fields, list)`` the fields with a list of such. What one
    by one is harmless may not be together, so the label is worked out again
    with all of them: ``kept`` says whether it held. One alone has been judged. Additions without a case are
    none; of equal places of a case the least addition comes first.

    A case meets its own additions only, by key. Of a case with many, each task
    passes on its first ``n`` harmless ones alone (a limited window), so not more
    than that for each task meet."""
    # parsing and deciding are many steps: worked out once for each row
    own = kept(P.decided(cases, "fields", parse, rules).select(*cases.columns, F.col("decision.choice").alias("label_before")))
    pairs = own.select(id_, "fields", "label_before").join(additions.select(id_, "place", "addition", "part"), id_)
    tried = pairs.withColumn("seen", seen(F.col("fields"), F.col("part"))).withColumn("after", joined(F.col("fields"), F.array("seen")))
    told = kept(P.decided(tried, "after", parse, rules).select(id_, "place", "addition", "seen", F.col("decision.choice").eqNullSafe(F.col("label_before")).alias("kept")))
    rn = F.row_number().over(Window.partitionBy(id_).orderBy("place", "addition"))
    first = told.where("kept").withColumn("rn", rn).where(F.col("rn") <= n).groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("rn", "addition", "seen"))).alias("xs"))
    counts = told.groupBy(id_).agg(F.count("*").alias("tried"), F.count_if(~F.col("kept")).alias("refused"))
    met = own.join(counts, id_, "left").join(first, id_, "left")
    added = F.coalesce(F.transform("xs", lambda x: x["addition"]), F.array().cast(f"array<{additions.schema['addition'].dataType.simpleString()}>"))
    whole = met.withColumn("after", F.when(F.size("xs") > 1, joined(F.col("fields"), F.transform("xs", lambda x: x["seen"]))))
    held = F.when(F.size("xs") > 1, F.col("decision.choice").eqNullSafe(F.col("label_before"))).otherwise(True)
    return P.decided(whole, "after", parse, rules).select(*cases.columns, F.coalesce("tried", F.lit(0)).cast("long").alias("tried"), F.coalesce("refused", F.lit(0)).cast("long").alias("refused"),
                                                          added.alias("added"), "label_before", held.alias("kept"))


def rule_index(intents: list[tuple[str, list[str]]] | None = None, symptom: str = "nurse_triage") -> list[tuple[str, str]]:
    """(destination, pattern): what in a text speaks for which destination, all rules in one list."""
    pairs = [(to, "|".join(f"(?:{p})" for p in patterns)) for to, patterns in (intents or P.INTENTS)]
    return [*pairs, (symptom, "|".join(f"(?:{p})" for p in P.SYMPTOMS))]


def spoken_for(text: Column, index: list[tuple[str, str]] | None = None) -> Column:
    """Every destination that anything in a text speaks for, in the order of the
    index: denied symptoms and later requests count too, since a reader could
    take them for the matter. ``text`` is on one line in lower case."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(to)) for to, p in (index or rule_index()))))


def planted(text: Column, known: list[str]) -> Column:
    """Known destinations that an embedded instruction names."""
    pattern = "|".join(f"(?:{p})" for p in P.INJECTIONS)
    said = F.array_join(F.regexp_extract_all(text, F.lit(f"(?is)({pattern})"), F.lit(1)), " ")
    named = F.array_distinct(F.regexp_extract_all(said, F.lit(r"\b[a-z]+(?:_[a-z]+)*\b"), F.lit(0)))
    return F.filter(named, lambda w: w.isin(known))


def confusers(text: Column, label: Column, suggested: Column | None = None, known: list[str] | None = None) -> Column:
    """Destinations a case could be mistaken for, none twice: those its text speaks for, those
    that instructions in it name, and one that someone without authority suggested; never
    its own label, nor the human review. A null text has none."""
    known = known or sorted({to for to, _ in rule_index()})
    parts = [spoken_for(text), planted(text, known)] + ([F.array_compact(F.array(suggested))] if suggested is not None else [])
    all_ = reduce(F.array_union, [F.coalesce(p, F.array().cast("array<string>")) for p in parts])
    return F.filter(all_, lambda d: ~d.eqNullSafe(label) & (d != P.HUMAN))
