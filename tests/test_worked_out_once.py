"""Steps of the policies that many rows or rules share are worked out once."""

from pyspark.sql import functions as F

from ruleloom.operators import audit as A
from ruleloom.operators import bodies as B
from ruleloom.operators import confusers as C
from ruleloom.operators import policies as P
from ruleloom.plans import policies as plans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_do_not_come_apart_into_words(spark):
    rows = spark.createDataFrame([(k, "Please rescheduel my vist, THANKS" if k % 2 else t) for k, t in enumerate(["", None, "x", None] * 50)], "id long, body string")
    fixed = P.correct_typos(rows, "id", "body", P.vocabulary(spark), "fixed")
    assert "Generate" not in plan(fixed) and "collect_list" not in plan(fixed)
    got = {r["body"]: r["fixed"] for r in fixed.collect()}
    assert got == {"": None, "x": "x", "Please rescheduel my vist, THANKS": "please reschedule my vist, thanks"}
    assert fixed.count() == 200 and fixed.columns == ["id", "body", "fixed"]


def test_instructions_are_taken_out_once(spark):
    decision = P.inbox_rules(F.col("both.e"), F.col("both.body"))
    assert decision._jc.toString().count("ignore the request details") == 1


def test_fillers_are_parsed_once_each(spark):
    """As many parses as cases and additions, and the same answer as with one for every pair."""
    cases = plans.chart_evidence(spark, SF).limit(40)
    made = cases.select("o_orderkey", F.coalesce(F.get_json_object("ev", "$.candidates[1]"), F.get_json_object("ev", "$.candidates[0]")).alias("addition"), F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    additions = made.withColumn("addition", F.when(F.col("place") == 0, F.col("addition")).otherwise(F.regexp_replace("addition", '"chart_id":"', '"chart_id":"9')))
    grown = lambda ev, xs: F.concat(F.substring(ev, F.lit(1), F.length(ev) - 2), F.lit(","), F.array_join(xs, ","), F.lit("]}"))
    told = [C.safe_additions(cases, "o_orderkey", "ev", additions, 2, grown, P.chart_evidence, P.chart_rules, *more) for more in ((), (P.chart_candidate, P.with_candidates))]
    one, two = (sorted(map(tuple, t.collect())) for t in told)
    assert one == two and len(one) == 40 and any(r[2] for r in one) and any(r[3] for r in one)


def test_checks_read_their_rows_once(spark):
    """One scan of what is checked, however many checks and examples; null keys are no examples."""
    rows = spark.createDataFrame([(k if k % 5 else None, k % 3 == 0) for k in range(200)], "k long, bad boolean").repartition(7)
    got = A.catalogue(rows, "k", [("third", F.col("bad"), True), ("none", F.lit(False), False), ("null", F.lit(None).cast("boolean"), True)])
    assert plan(got).count("RepartitionByExpression") + plan(got).count("Repartition ") == 1
    found = {r["check"]: (r["n_checked"], r["n_failed"], r["examples"]) for r in got.collect()}
    due = ",".join(str(k) for k in [k for k in range(200) if k % 3 == 0 and k % 5][:25])
    assert found["third"] == (200, 67, due) and found["none"] == (200, 0, "") and found["null"][1] == 200 and found["null"][2].startswith("1,2,3,4,6")
    assert {r["n_checked"] for r in A.catalogue(rows.limit(0), "k", [("third", F.col("bad"), True)]).collect()} == {0}


def test_values_found_are_not_looked_into_again(spark):
    rows = spark.createDataFrame([(1, '{"a":[1,{"b":{}}],"c":null}'), (2, "no json"), (3, None)], "k long, body string")
    found = B.leaves(rows, ["k"], "body")
    assert "CASE WHEN" in plan(found) and "open" in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, "$.a[0]", "1"), (1, "$.a[1].b", "{}"), (1, "$.c", "null"), (2, "$", "no json")]
