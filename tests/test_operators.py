"""Operators on small frames with values worked out by hand."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from ruleloom.functions import canon, stats
from ruleloom.functions import text as X
from ruleloom.operators import audit, dedup, paired, resample, sampling
from ruleloom.operators import validate as V
from ruleloom.sources import records
from ruleloom.streaming import budget


def test_wilson_and_mcnemar(spark):
    df = spark.createDataFrame([(8, 10, 5, 1), (0, 0, 0, 0), (10, 10, 60, 59)], "k int, n int, b int, c int")
    got = df.select(*stats.wilson(F.col("k"), F.col("n")), *stats.wilson_clamped(F.col("k"), F.col("n")), stats.mcnemar_exact(F.col("b"), F.col("c"))).collect()
    assert [round(x, 4) for x in got[0][:3]] == [0.8, 0.4902, 0.9433] and got[1][0] is None and got[2][5] <= 1.0
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0
    for r, (b, c) in zip(got, [(5, 1), (0, 0), (60, 59)]):
        assert abs(r[6] - exact(b, c)) < 1e-9


def test_text(spark):
    df = spark.createDataFrame([(" a\t b\n", "Hi there. Go?  Now", "refill", "rfeill"), ("", "", "ab", "ba"), (None, None, "abc", "abcde")], "x string, s string, a string, b string")
    got = df.select(X.collapse(F.col("x")), X.blank_to_null(F.col("x")), X.sentences(F.col("s")), X.one_edit(F.col("a"), F.col("b"))).collect()
    assert tuple(got[0]) == ("a b", "a\t b", ["Hi there.", "Go?", "Now"], True) and got[1][1] is None and got[1][3] and got[2][2] is None and not got[2][3]
    r = spark.range(1).select(X.redact(F.lit("Bearer abc.def and api_key=xyz")), X.fill(F.lit("{a}-{b}"), {"a": F.lit("1"), "b": F.lit("2")}), X.strip_comments(F.lit("x<!-- a\nb -->y")), X.reason_prefix(F.lit("rule_1: why"))).first()
    assert tuple(r) == ("[redacted] and [redacted]", "1-2", "xy", "rule_1")


@pytest.mark.parametrize("body, reason", [
    ('{"choice":"a","probabilities":{"a":0.6,"b":0.4},"confidence":0.6}', None), ("x", "not_json"), ("[]", "not_object"), ('{"choice":null}', "choice_missing"), ('{"choice":1}', "choice_not_string"),
    ('{"choice":"c"}', "choice_not_offered"), ('{"choice":"a"}', "probabilities_missing"), ('{"choice":"a","probabilities":{"a":1}}', "probability_key_missing"),
    ('{"choice":"a","probabilities":{"a":0.6,"b":0.4,"c":0}}', "probability_key_extra"), ('{"choice":"a","probabilities":{"a":1.6,"b":-0.6}}', "probability_not_unit"),
    ('{"choice":"a","probabilities":{"a":0.6,"b":0.1}}', "probabilities_sum"), ('{"choice":"a","probabilities":{"a":0.6,"b":0.4}}', "confidence_not_unit"), (None, "not_json")])
def test_decision_reasons(spark, body, reason):
    df = spark.createDataFrame([(body,)], "body string")
    assert df.select(V.decision_reason(F.col("body"), F.array(F.lit("a"), F.lit("b")))).first()[0] == reason


def test_chat_and_unit(spark):
    keys = F.array(F.lit("a"), F.lit("b"))
    df = spark.createDataFrame([('{"choice":"a"}',), ("I say b, not a",), ('{"choice":"a","x":1}',), (None,), ('{"x":1}',), ('{"choice":"z"}',)], "c string")
    assert [tuple(r) for r in df.select(V.chat_reason(F.col("c"), keys), V.lenient_choice(F.col("c"), keys)).collect()] == [
        (None, "a"), ("not_json", "b"), ("extra_keys", "a"), ("content_missing", None), ("choice_missing", None), ("choice_not_offered", None)]
    u = spark.createDataFrame([('{"p":0.5}',), ('{"p":true}',), ('{"p":"0.5"}',), ('{"p":2}',), ("{}",)], "j string")
    assert [r[0] for r in u.select(V.finite_unit(F.try_parse_json("j"), "$.p")).collect()] == [True, False, False, False, False]


def test_canonical_json(spark):
    texts = ['{"b":1,"a":[1.0,null,"é\\n"]}', '{"\\uffff":1,"\\ud83d\\ude00":2}', "no", None, '{"x":1e21}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canon.canonical_json("t")).collect()]
    want = [json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if t and t != "no" else None for t in texts]
    assert got == want and got[1].index("￿") < got[1].index("😀")
    df = spark.createDataFrame([("chart", '{"z":1,"a":2}', '{"9":"x","10":"y"}', "p")], "w string, e string, o string, p string")
    body = '{"evidence":{"a":2,"z":1},"options_pairs":[["9","x"],["10","y"]],"policy_text":"p","workflow":"chart"}'
    assert df.select(canon.input_hash("w", "e", "o", "p")).first()[0] == hashlib.sha256(body.encode()).hexdigest()
    assert [r[0] for r in spark.createDataFrame([("p",), ("p\n",)], "p string").select(canon.instruction_text(F.col("p"), "s")).collect()] == ["p s", "p\ns"]


def test_sources(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"id":1,"o":{"9":"x","z":"y","10":"w"}}\n\nnot json\n[1]\n{"id":2}\n')
    rows = records.tolerant_lines(spark, str(f), "id long, o string").cache()
    assert tuple(records.bad_lines(rows).first())[0] >= 2
    assert [r["problem"] for r in records.audited_lines(spark, str(f)).orderBy("line_no").collect()] == [None, "not json", "not an object", None]
    with pytest.raises(Exception):
        records.strict_lines(spark, str(f), "id long").collect()
    assert records.optional_lines(spark, f"{tmp_path}/none.jsonl", "id long").count() == 0 and records.optional_lines(spark, str(f), "id long").count() >= 3
    o = spark.createDataFrame([('{"9":"x","z":"y","10":"w"}',), ('{"a":1,"a":2}',)], "j string")
    assert [[tuple(x) for x in r[0]] for r in o.limit(1).select(records.ordered_options(F.col("j"))).collect()] == [[("9", "x"), ("z", "y"), ("10", "w")]]
    assert [r[0] for r in o.select(records.has_repeated_key(F.col("j"))).collect()] == [False, True]
    found = records.checksums(spark, str(tmp_path)).withColumn("file", F.substring_index("file", "/", -1))
    assert found.first()["digest"] == hashlib.sha256(f.read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("a.jsonl", "0"), ("gone", "1")], "file string, digest string")
    assert {tuple(r) for r in records.verify_checksums(found, manifest).collect()} == {("a.jsonl", "changed"), ("gone", "missing")}
    records.write_once(o, f"{tmp_path}/once")
    with pytest.raises(Exception):
        records.write_once(o, f"{tmp_path}/once")
    records.write_csv(spark.createDataFrame([(1, 2)], "b int, a int"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["a", "b"]
    (tmp_path / "plan.json").write_text('{"trials":\n[{"trial_id":"t"}]}')
    plan = records.documents(spark, f"{tmp_path}/plan.json").select(F.explode("trials").alias("t")).select("t.*")
    assert records.derive_plan(plan, "x").first()["arm_order"] == ["x"]


def test_audit_and_pairs(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(90)], "id long, v int")
    r = audit.check("v", df, "id", F.col("v") == 0).first()
    assert (r["n_checked"], r["n_failed"], r["examples"].split(",")[:2], len(r["examples"].split(","))) == (90, 30, ["0", "3"], 25)
    marks = spark.createDataFrame([("a", 1, 10), ("a", 5, 20)], "k string, t int, m int")
    got = audit.as_of(spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 9), ("b", 9)], "k string, t int"), marks, "k", "t", "m")
    assert {(x["k"], x["t"]): x["m"] for x in got.collect()} == {("a", 0): None, ("a", 1): 10, ("a", 4): 10, ("a", 9): 20, ("b", 9): None}
    w = spark.createDataFrame([("form",), ("from",), ("fork",), ("worm",)], "a string")
    assert {tuple(x) for x in dedup.one_edit_pairs(w, spark.createDataFrame([("form",)], "b string"), "a", "b").collect()} == {("form", "form"), ("from", "form"), ("fork", "form"), ("worm", "form")}
    c = spark.createDataFrame([(1, True, True), (1, True, False), (1, False, True)], "g int, a boolean, b boolean")
    assert tuple(paired.contingency(c, ["g"], F.col("a"), F.col("b")).first()) == (1, 1, 1, 1, 0, 1.0)


def test_sampling(spark):
    df = spark.createDataFrame([(i, f"s{i % 7}") for i in range(100)], "id long, s string")
    assert sampling.proportional(df, "s", "id", 31, "x").count() == 31 and sampling.round_robin(df, "s", "id", 20, "x").groupBy("s").count().agg(F.max("count")).first()[0] == 3
    got = df.select("s", sampling.hash_mod20(F.col("s"))).distinct().collect()
    assert all(b == int(hashlib.sha256(s.encode()).hexdigest(), 16) % 20 for s, b in got)


def test_bootstrap_and_shards(spark):
    df = spark.createDataFrame([("g", i % 4 != 0) for i in range(400)] + [("one", True)], "g string, ok boolean").withColumn("ok", F.col("ok").cast("int"))
    r = {x["g"]: x for x in resample.bootstrap(df, "g", ["ok"], resample.mean_statistic).collect()}
    assert r["g"]["value"] == 0.75 and 0.70 < r["g"]["low"] < 0.75 < r["g"]["high"] < 0.80 and r["one"]["low"] == r["one"]["high"] == 1
    fam = spark.createDataFrame([(i, i % 5 + 1) for i in range(200)], "f long, n int")
    out = resample.greedy_shards(fam, "f", "n", 12, F.sha2(F.col("f").cast("string"), 256))
    assert out.count() == 200 and out.groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= 12


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [("b", i, 10, None if i % 3 == 0 else 4) for i in range(10)] + [("c", 99, 50, None)]
    schema = "budget string, attempt_id long, reserved_nano long, cost_nano long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = budget.admit(spark.readStream.schema(schema).parquet(src), 40).writeStream.format("memory").queryName("admitted").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["budget"], r["attempt_id"]): (r["admitted"], r["spent_nano"]) for r in spark.table("admitted").collect()}
    spent = 0
    for b, i, reserved, cost in rows[:10]:
        ok = spent + reserved <= 40
        spent += (reserved if cost is None else cost) if ok else 0
        assert got[(b, i)] == (ok, spent)
    assert got[("c", 99)] == (False, 0)
    ev = "ts timestamp, event_type string, value double, trial_id string"
    spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 'error' AS event_type, 1.0D AS value, 't' AS trial_id UNION ALL SELECT timestamp'2024-01-01 00:00:20', 'ok', 3.0D, 't'").coalesce(1).write.parquet(f"{tmp_path}/ev")
    s = spark.readStream.schema(ev).parquet(f"{tmp_path}/ev")
    for name, df, mode in (("rolled", budget.status(s, "ts", "1 minute", "0 seconds"), "complete"), ("fresh", budget.unseen(s, "ts", "1 minute"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r)[1:3] for r in spark.table("rolled").collect()] == [(2, 1)] and spark.table("fresh").count() == 1
    assert budget.drifted(spark.createDataFrame([("a",), ("b",), (None,)], "api_model string"), ["a"]).count() == 2


def test_swap_noise_swaps_neighbours(spark):
    from ruleloom.operators.planning import swap_noise

    text = "abcdefgh Abcdefgh short " * 40
    out = spark.createDataFrame([(1, text)], "i int, t string").select(swap_noise(F.col("t"), "s", F.col("i"))).first()[0]
    changed = [(a, b) for a, b in zip(text.split(" "), out.split(" ")) if a != b]
    assert 0 < len(changed) < 40 and all(a == "abcdefgh" and sorted(a) == sorted(b) and sum(x != y for x, y in zip(a, b)) == 2 for a, b in changed)
