"""Sampling and planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.operators import sampling as M
from ruleloom.sources.tables import table

SEED = "plan-7"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


def top8_per_group(spark, sf_dir):
    return M.top_per_group(_docs(spark, sf_dir), "source", M.shuffle_key(SEED, F.col("doc_id")), 8).select("source", "doc_id", "rn")


def stratified_round_robin(spark, sf_dir):
    return M.round_robin(_docs(spark, sf_dir), "source", "doc_id", 150, SEED).select("doc_id", "source")


def proportional_largest_remainder(spark, sf_dir):
    return M.proportional(_docs(spark, sf_dir), "lang", "doc_id", 137, SEED).select("doc_id", "lang")


def balanced_factors(spark, sf_dir):
    return M.balanced(_docs(spark, sf_dir), "source", "doc_id", 4, SEED).groupBy("source", "level").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def hash_split(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", M.hash_mod20(F.col("c_name")).alias("bucket"))
    return t.select("c_custkey", "bucket", F.when(F.col("bucket") == 0, "validation").otherwise("train").alias("split"))


def grouped_val_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey")
    return M.grouped_split(rows, "o_orderpriority", "o_custkey", 0.1, SEED).groupBy("o_orderpriority", "split").agg(F.count("*").alias("families"), F.sum("n").alias("rows"))


def trial_plan(spark, sf_dir):
    phase = F.when(F.col("doc_id") % 10 == 0, "repeat").when(F.col("doc_id") % 5 == 1, "holdout").otherwise("broad")
    reps = F.when(F.col("doc_id") % 10 == 0, F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1)))
    return M.plan(_docs(spark, sf_dir), "doc_id", phase, reps, SEED)


def counterfactual_edits(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    options = [("balance", F.col("c_acctbal") > 0, F.lit("-1")), ("segment", F.col("c_mktsegment") != "BUILDING", F.lit("BUILDING")),
               ("nation", F.col("c_nationkey") > 10, F.col("c_nationkey") - 1), ("drop", F.col("c_custkey") % 2 == 0, F.lit("null"))]
    return M.edits(c, "c_custkey", options, 2, SEED)


def options_shuffled(spark, sf_dir):
    """A required option, then others by hash, cut to three."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    others = F.array(*(F.lit(f"Brand#{i}") for i in range(1, 9)))
    keyed = F.array_sort(F.transform(F.filter(others, lambda o: o != F.col("p_brand")), lambda o: F.struct(F.sha2(F.concat_ws("|", F.lit(SEED), F.col("p_partkey").cast("string"), o), 256).alias("k"), o.alias("o"))))
    chosen = F.array_union(F.array("p_brand"), F.slice(F.transform(keyed, lambda s: s["o"]), 1, 2))
    return p.select("p_partkey", F.array_join(chosen, ",").alias("options"))


QUERIES = {f.__name__: f for f in (top8_per_group, stratified_round_robin, proportional_largest_remainder, balanced_factors, hash_split, grouped_val_split, trial_plan, counterfactual_edits, options_shuffled)}

_K = f"sha256('{SEED}|' || {{}}::VARCHAR)"
ORACLE_SQL = {
    "top8_per_group": f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_K.format('doc_id')})::INTEGER AS rn FROM documents QUALIFY rn <= 8",
    "stratified_round_robin": f"""
        SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_K.format('doc_id')}) AS rn FROM documents)
        ORDER BY rn, {_K.format('source')}, source LIMIT 150""",
    "proportional_largest_remainder": f"""
        WITH s AS (SELECT lang, count(*)::BIGINT AS size, (sum(count(*)) OVER ())::BIGINT AS total FROM documents GROUP BY 1),
        e AS (SELECT lang, size * 137 // total AS f, size * 137 % total AS r FROM s),
        q AS (SELECT lang, f + CASE WHEN row_number() OVER (ORDER BY r DESC, lang) <= 137 - (SELECT sum(f) FROM e) THEN 1 ELSE 0 END AS quota FROM e)
        SELECT doc_id, d.lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_K.format('doc_id')}) AS rn FROM documents) d JOIN q ON d.lang = q.lang WHERE rn <= quota""",
    "balanced_factors": f"""
        SELECT source, level, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM (
          SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY {_K.format('doc_id')}) - 1) % 4)::INTEGER AS level FROM documents) GROUP BY 1, 2""",
    "hash_split": """
        WITH h AS (SELECT c_custkey, list_transform(string_split(sha256(c_name), ''), lambda c: strpos('0123456789abcdef', c) - 1) AS d FROM customer),
        b AS (SELECT c_custkey, ((d[-1] + 16 * (list_sum(d) - d[-1])) % 20)::INTEGER AS bucket FROM h)
        SELECT c_custkey, bucket, CASE WHEN bucket = 0 THEN 'validation' ELSE 'train' END AS split FROM b""",
    "grouped_val_split": f"""
        WITH f AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2),
        s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY {_K.format('o_custkey')}, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.1 * sum(n) OVER (PARTITION BY o_orderpriority) AS v FROM f)
        SELECT o_orderpriority, CASE WHEN v THEN 'validation' ELSE 'train' END AS split, count(*)::BIGINT AS families, sum(n)::BIGINT AS rows FROM s GROUP BY 1, 2""",
    "trial_plan": f"""
        WITH c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'repeat' WHEN doc_id % 5 = 1 THEN 'holdout' ELSE 'broad' END AS phase,
          unnest(CASE WHEN doc_id % 10 = 0 THEN [1, 2, 3] ELSE [1] END)::INTEGER AS rep FROM documents),
        t AS (SELECT doc_id::VARCHAR || '#' || phase || '#r' || rep::VARCHAR AS trial_id, doc_id AS case_id, phase, rep FROM c)
        SELECT *, CASE WHEN substr({_K.format('trial_id')}, 1, 1) < '8' THEN 'first,second' ELSE 'second,first' END AS arm_order FROM t""",
    "counterfactual_edits": f"""
        WITH e AS (SELECT c_custkey, 'balance' AS edit, '-1' AS value FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'segment', 'BUILDING' FROM customer WHERE c_mktsegment <> 'BUILDING'
          UNION ALL SELECT c_custkey, 'nation', (c_nationkey - 1)::VARCHAR FROM customer WHERE c_nationkey > 10 UNION ALL SELECT c_custkey, 'drop', 'null' FROM customer WHERE c_custkey % 2 = 0)
        SELECT c_custkey, edit, value FROM e QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY sha256('{SEED}|' || c_custkey::VARCHAR || '|' || edit)) <= 2""",
    "options_shuffled": f"""
        WITH o AS (SELECT p_partkey, p_brand, unnest(['Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8']) AS o FROM part),
        r AS (SELECT p_partkey, p_brand, o, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256('{SEED}|' || p_partkey::VARCHAR || '|' || o)) AS rn FROM o WHERE o <> p_brand)
        SELECT p_partkey, p_brand || ',' || string_agg(o, ',' ORDER BY rn) AS options FROM r WHERE rn <= 2 GROUP BY p_partkey, p_brand""",
}
