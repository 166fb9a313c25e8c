"""Queries that need code beyond SQL: resampling, shards, canonical JSON, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ruleloom.functions.canon import canonical_json
from ruleloom.operators import policies as P
from ruleloom.operators import resample as B
from ruleloom.operators import sampling as M
from ruleloom.sources import records
from ruleloom.sources.journal import Journal
from ruleloom.sources.shared import shared_dir
from ruleloom.sources.tables import table
from ruleloom.streaming import budget


def bootstrap_accuracy(spark, sf_dir):
    """Bootstrap interval of accuracy by source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return B.bootstrap(rows, "source", ["quality"], B.mean_statistic)


def bootstrap_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "N").cast("int").alias("a"), (F.col("l_linestatus") == "O").cast("int").alias("b"))
    return B.bootstrap(rows, "l_linenumber", ["a", "b"], B.difference_statistic, resamples=1_000, upper_offset=-1)


def shard_families(spark, sf_dir):
    fam = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return B.greedy_shards(fam, "o_custkey", "n", 95, M.shuffle_key("plan-7", F.col("o_custkey")))


def canonical_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"z": [1, 2.5, null], "a": '), F.col("props"), F.lit("}")).alias("j"))
    return e.select("event_id", F.sha2(canonical_json("j"), 256).alias("digest"))


def ordered_option_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('{"9":"x","'), F.col("p_partkey").cast("string"), F.lit('0":"y","1":"z"}')).alias("j"))
    return p.select("p_partkey", F.array_join(F.transform(records.ordered_options(F.col("j")), lambda o: F.concat(o["key"], F.lit("="), o["description"])), ",").alias("options"))


def mock_answers(spark, sf_dir):
    status, choice = records.mock_answer(F.col("event_id").cast("string"), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    rows = table(spark, sf_dir, "events").select(status.alias("status"), choice.alias("choice"))
    return rows.groupBy("status", "choice").agg(F.count("*").alias("n"))


def results_policy(spark, sf_dir):
    """The results policy over orders written as notifications."""
    o = table(spark, sf_dir, "orders")
    n = F.struct(F.lit("Result").alias("message_class"), F.when(F.col("o_orderkey") % 4 == 0, "Radiology").when(F.col("o_orderkey") % 4 == 1, "Pathology").otherwise("Lab panel").alias("item_type"),
                 F.struct(F.lit("A").alias("name"), F.col("o_custkey").cast("string").alias("mrn"), F.when(F.col("o_custkey") % 7 != 0, "2000-01-01").alias("dob")).alias("patient"),
                 F.when(F.col("o_orderpriority").startswith("1"), "Critical").otherwise("normal").alias("source_flag"), F.when(F.col("o_orderkey") % 10 == 3, "NORMAL").alias("notification_banner"),
                 F.when(F.col("o_orderstatus") == "P", "Preliminary").when(F.col("o_orderstatus") == "F", "Final").otherwise("Corrected").alias("result_status"),
                 F.when(F.col("o_orderpriority").startswith("5"), "outside").otherwise("inside").alias("performing_org_type"))
    ev = o.select("o_orderkey", F.to_json(F.struct(n.alias("notification"))).alias("ev"))
    return P.decided(ev, "ev", P.results_evidence, P.results_rules).select("o_orderkey", "decision.choice", "decision.reason")


def streaming_budget(spark, sf_dir):
    """The events as a stream, admitted under a cap for each type; read back when all are through."""
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{path}*")
    attempts = rows.select(F.col("event_type").alias("budget"), F.col("event_id").alias("attempt_id"), F.lit(2_000_000_000).cast("long").alias("reserved_nano"),
                           F.when(F.col("event_id") % 4 != 0, F.ceil(F.col("value") * 1e9 - 1e-6)).cast("long").alias("cost_nano"))
    folder = f"{shared_dir(spark)}/budget-{uuid.uuid4().hex}"
    writer = budget.admit(attempts, 500_000_000_000).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{folder}/log").start(f"{folder}/rows").awaitTermination()
    done = spark.read.schema(budget.SPEND).parquet(f"{folder}/rows")
    return done.groupBy("budget").agg(F.count_if("admitted").alias("admitted"), F.max("spent_nano").alias("spent_nano"), F.count("*").alias("n"))


def journal_lines(spark, sf_dir):
    """The events appended to a journal in two runs, with lines that are no objects, and read back: how many of each kind, and what they hold."""
    spark.dataSource.register(Journal)
    folder = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    k = F.col("event_id")
    line = F.when(k % 10 == 3, F.concat(F.lit("[1, "), F.col("props"), F.lit("]"))).when(k % 10 == 4, F.concat(F.lit("{"), F.col("props"))).when(k % 10 == 5, " ").otherwise(F.to_json(F.struct("event_id", "event_type")))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("text"))
    for run in (0, 1):
        rows.where(k % 2 == run).select("text").write.format("journal").mode("append").save(folder)
    back = spark.read.format("journal").load(folder).select("problem", F.from_json("text", "event_id long, event_type string").alias("e"))
    whole = F.when(F.col("problem").isNull(), F.col("e.event_id"))
    return back.groupBy("problem", F.when(F.col("problem").isNull(), F.col("e.event_type")).alias("event_type")).agg(F.count("*").alias("n"), F.sum(whole).alias("ids"))


QUERIES = {f.__name__: f for f in (bootstrap_accuracy, bootstrap_difference, shard_families, canonical_props, ordered_option_keys, mock_answers, results_policy, streaming_budget, journal_lines)}

ORACLE_SQL = {
    "journal_lines": """
        SELECT CASE event_id % 10 WHEN 3 THEN 'not an object' WHEN 4 THEN 'not json' END AS problem, CASE WHEN event_id % 10 NOT IN (3, 4) THEN event_type END AS event_type, count(*)::BIGINT AS n,
          sum(CASE WHEN event_id % 10 NOT IN (3, 4) THEN event_id END)::BIGINT AS ids FROM events WHERE event_id % 10 <> 5 GROUP BY 1, 2""",
    "streaming_budget": """
        WITH RECURSIVE a AS (SELECT event_type AS budget, 2000000000::BIGINT AS reserved, CASE WHEN event_id % 4 <> 0 THEN ceil(value * 1e9 - 1e-6)::BIGINT END AS cost, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
        s AS (SELECT budget, rn, true AS ok, coalesce(cost, reserved) AS spent FROM a WHERE rn = 1
          UNION ALL SELECT a.budget, a.rn, s.spent + reserved <= 500000000000, s.spent + CASE WHEN s.spent + reserved <= 500000000000 THEN coalesce(cost, reserved) ELSE 0 END FROM s JOIN a ON a.budget = s.budget AND a.rn = s.rn + 1)
        SELECT budget, count(*) FILTER (WHERE ok)::BIGINT AS admitted, max(spent)::BIGINT AS spent_nano, count(*)::BIGINT AS n FROM s GROUP BY 1""",
    "shard_families": """
        WITH RECURSIVE f AS (SELECT o_custkey, count(*)::BIGINT AS size, sha256('plan-7|' || o_custkey::VARCHAR) AS key FROM orders GROUP BY 1),
        b AS (SELECT *, ('0x' || substr(key, 1, 7))::BIGINT % greatest(16, (SELECT ceil(count(*) / 4096) FROM f)::BIGINT) AS block FROM f),
        p AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY key, o_custkey) AS rn FROM b),
        g AS (SELECT block, rn, o_custkey, size, 0::BIGINT AS shard, size AS used FROM p WHERE rn = 1
          UNION ALL SELECT p.block, p.rn, p.o_custkey, p.size, g.shard + CASE WHEN g.used + p.size > 95 THEN 1 ELSE 0 END, CASE WHEN g.used + p.size > 95 THEN p.size ELSE g.used + p.size END
          FROM g JOIN p ON p.block = g.block AND p.rn = g.rn + 1)
        SELECT o_custkey, 'b' || block || '-s' || shard AS shard, size FROM g""",
    "canonical_props": """SELECT event_id, sha256('{"a":{"k":' || json_extract_string(props, '$.k') || '},"z":[1,2.5,null]}') AS digest FROM events""",
    "ordered_option_keys": "SELECT p_partkey, '9=x,' || p_partkey || '0=y,1=z' AS options FROM part",
    "mock_answers": """
        WITH n AS (SELECT ('0x' || substr(sha256(event_id::VARCHAR), 1, 8))::BIGINT AS n FROM events),
        s AS (SELECT n, CASE WHEN n % 100 < 3 THEN 429 WHEN n % 100 < 5 THEN 503 ELSE 200 END AS status FROM n)
        SELECT status, CASE WHEN status = 200 THEN ['a', 'b', 'c'][n % 3 + 1] END AS choice, count(*)::BIGINT AS n FROM s GROUP BY 1, 2""",
    "results_policy": """
        SELECT o_orderkey, split_part(d, '|', 1) AS choice, split_part(d, '|', 2) AS reason FROM (SELECT o_orderkey, CASE
          WHEN o_custkey % 7 = 0 THEN 'needs_human_review|results_rule_2_identity'
          WHEN starts_with(o_orderpriority, '1') AND o_orderkey % 10 = 3 THEN 'needs_human_review|results_rule_3b_flag_conflict'
          WHEN starts_with(o_orderpriority, '1') THEN 'critical_results|results_rule_4_critical'
          WHEN o_orderstatus NOT IN ('P', 'F') THEN 'corrected_results|results_rule_5c_corrected' WHEN o_orderstatus = 'P' THEN 'preliminary_results|results_rule_5d_preliminary'
          WHEN starts_with(o_orderpriority, '5') THEN 'outside_results|results_rule_6_outside'
          ELSE (CASE o_orderkey % 4 WHEN 0 THEN 'imaging_results' WHEN 1 THEN 'pathology_review' ELSE 'results' END) || '|results_rule_7_type' END AS d FROM orders)""",
}
