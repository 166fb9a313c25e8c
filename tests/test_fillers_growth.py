"""safe_fillers: what grows with cases and additions is a narrow step, not one more parse of the evidence."""

import json
import re

from pyspark.sql import functions as F

from ruleloom.functions import text as X
from ruleloom.operators import confusers as C
from ruleloom.operators import policies as P
from ruleloom.plans import policies as plans

SF = "/root/testdata/sf0.001"
ANN = {"chart_id": "1", "name": "Ann Lee", "dob": "1990-01-02", "phone": "555-0101", "email": "a@x.test"}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_not_parsed_again_for_what_is_kept(spark):
    """Charts are parsed by customer and cases by order, before any pair meets; behind that, nothing is."""
    told = plans.safe_fillers(spark, SF)
    assert "from_json" not in plan(told).lower() and "jsontostructs" not in plan(told).lower()


ODD = [
    ({"mrn": "1", "name": "LEE, ANN", "dob": "1/2/1990"}, [ANN]), ({" MRN ": " 1\t", "\tName": " Ann  Lee"}, [ANN]), ({"mrn": " ", "name": "Ann Lee", "dob": "Jan 2, 1990", "phone": "5550101"}, [ANN]),
    ({"mrn": "1"}, [ANN, ANN]), ({"mrn": "7"}, [ANN]), ({"name": "Ann Lee", "dob": "1990-01-02", "phone": "555-0101"}, [ANN, ANN | {"chart_id": "2"}]), ({"name": "Ann Lee", "dob": "someday", "detail": "Phone ending 0101; Email a@x.test."}, [ANN | {"dob": "SOMEDAY"}]),
    ({"name": "Ann Lee", "detail": "Phone ending 0101; Email a@x.test."}, [{" Chart_ID": "4", "NAME": "Lee,Ann", "phone": "555-0101", "email": "A@X.test"}]), ({"name": "Ann Lee"}, []), ({}, [ANN]), ({"mrn": "1", "name": ""}, [None, ANN]), (None, None), ({"a\nb": "x\ny", "mrn": "1\n"}, [ANN])]


def _odd(spark):
    texts = [json.dumps({"request": r, "candidates": c}) for r, c in ODD] + ['{"request":{"mrn":"7","mrn":"1","name":"Ann Lee"},"candidates":[%s]}' % json.dumps(ANN), "no json", "{}", None]
    return spark.createDataFrame(list(enumerate(texts)), "i long, ev string")


def test_cases_in_rows_are_decided_as_in_one_expression(spark):
    rows = _odd(spark)
    one = {r["i"]: (r["d"]["choice"], r["d"]["reason"]) for r in rows.select("i", P.chart_decision(F.col("ev")).alias("d")).collect()}
    two = {r["i"]: (r["d"]["choice"], r["d"]["reason"]) for r in P.chart_cases(rows, "i", "ev").select("i", P.chart_case_rules(F.col("fields")).alias("d")).collect()}
    assert one == two and len(two) == len(ODD) + 4
    assert [two[i][0] for i in range(8)] == ["1", "1", "1", P.HUMAN, P.HUMAN, P.HUMAN, "1", "4"] and two[13] == ("1", "chart_rule_1")


def test_parts_seen_once_give_the_same_additions(spark):
    """Matches beside a case, counted, and the grown evidence parsed for every pair: the same answers."""
    cases = _odd(spark)
    extra = [ANN, ANN | {"chart_id": "91"}, {"chart_id": "3", "name": "Bob Ray"}, ANN | {"chart_id": "92", "dob": "1/3/1990"}, {}]
    rows = [(i, place, json.dumps(a)) for i in range(len(ODD) - 2) for place, a in enumerate(extra[i % 2:])]
    additions = spark.createDataFrame([*rows, (99, 0, "{}")], "i long, place int, addition string")

    def grown(ev, xs):
        return F.concat(F.substring(ev, F.lit(1), F.length(ev) - 2), F.when(ev.endswith("[]}"), "").otherwise(","), F.array_join(xs, ","), F.lit("]}"))

    slow = C.safe_additions(cases, "i", "ev", additions, 2, grown, P.chart_evidence, P.chart_rules)
    parts = additions.withColumn("part", P.chart_candidate(F.col("addition")))
    fast = C.safe_parts(P.chart_cases(cases, "i", "ev"), "i", parts, 2, P.chart_matched, P.chart_joined, P.chart_case_rules)
    names = ["i", "tried", "refused", "added", "label_before", "kept"]
    one, two = (sorted(map(repr, d.select(names).collect())) for d in (slow, fast))
    assert one == two and len(one) == len(ODD) + 4 and any("refused=1" in r for r in one) and any("refused=2" in r for r in one)


def test_details_are_flat_and_equal(spark):
    """Steps as columns make what one expression makes."""
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (_, cs) in enumerate(ODD) for c in cs or [None]], "i long, c string").select("i", F.from_json("c", P.CANDIDATE_JSON).alias("m"))
    flat = P.with_details(rows.withColumn("f", F.col("m")), "f", P.CANDIDATE)
    assert all(r["f"] == r["e"] for r in flat.select("f", P.chart_candidate(F.to_json("m")).alias("e")).where("m is not null").collect())


def test_names_and_dates_as_before(spark):
    names = ["Ann Lee", "LEE, Ann Q.", "O'Brien", "Smith-Jones, Li, Jr.", " ,", ",Ann", "Ann,", "a - b", " Ann Lee﻿", "Zoë Ray", "", "- -", "Ann\nLee", None]

    def person(x):
        if x is None:
            return None
        t = re.sub("[\\s  ﻿]+", " ", x).strip(" ").lower()
        t = t.split(",", 1)[1] + " " + t.split(",", 1)[0] if "," in t else t
        parts = [p for p in (re.sub("[^a-z]", "", w) for w in t.split(" ")) if p]
        return (parts[0], parts[-1] if len(parts) > 1 else "") if parts else None

    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [tuple(r[0]) if r[0] else None for r in df.orderBy("i").select(X.person(F.col("n"))).collect()] == [person(n) for n in names]
    dates = ["2000-02-29", "1900-2-29", "2000-2-3", "2/30/2000", "12/31/1999", "13/1/2000", "0/1/2000", "0000-01-01", "1582-10-10", "Feb 29, 1900", "feb 9 2000", "SEPTEMBER 30, 2020", "Sep 31, 2020", "Foo 3, 2020", "2000-02-03T00:00:00", "1-1-2000", ""]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, d string")
    named = F.concat_ws(" ", F.initcap(F.lower(F.substring("d", 1, 3))), F.regexp_extract("d", r"^[A-Za-z]{3,9}\.?[ ]+([0-9]{1,2})", 1), F.regexp_extract("d", r"([0-9]{4})$", 1))
    old = F.coalesce(F.when(F.col("d").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date("d", "yyyy-M-d")), F.when(F.col("d").contains("/"), F.try_to_date("d", "M/d/yyyy")), F.when(F.col("d").rlike("^[A-Za-z]"), F.try_to_date(named, "MMM d yyyy")))
    got = df.orderBy("i").select(X.parse_date(F.col("d")).cast("string").alias("new"), old.cast("string").alias("old")).collect()
    assert [r["new"] for r in got] == [r["old"] for r in got] and got[0]["new"] == "2000-02-29" and got[10]["new"] == "2000-02-09" and got[9]["new"] is None
