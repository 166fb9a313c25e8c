"""Queries on building and guarding runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.operators import planning as P
from ruleloom.sources.tables import table

SEED = "plan-7"


def arms_joined(spark, sf_dir):
    """Users that both clicked and bought, with their first values."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("v"))
    return P.arms(e, "user_id", "event_type", ["click", "purchase"], "v")


def core_shard(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), F.col("l_orderkey").alias("family"), F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).alias("base"))
    return P.core_shard(li, "case_id", "family", "base", F.col("family") % 5 == 0, 40, 60, SEED)


def label_quota(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return P.label_quota(d, "lang", "doc_id", F.col("quality") == 0, 0.5, SEED).select("doc_id", "lang", "quality")


def typo_noise(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark")
    return d.select("item_id", P.swap_noise(F.col("text"), SEED, F.col("item_id")).alias("noisy"))


def filler_candidates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("block"), F.col("s_name").alias("name"))
    pool = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_name").alias("name"))
    return P.fillers(s, pool, "s_suppkey", "block", "name", 3, SEED).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.count_distinct("name").alias("different"))


def deadline_admission(spark, sf_dir):
    ok = P.within_deadline(F.col("ts"), F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 23 HOURS"), 1800)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(ok).alias("admitted"), F.count_if(~ok).alias("refused"))


def input_guard(spark, sf_dir):
    """A table and the same table in another order guard alike; a changed one doesn't."""
    n = table(spark, sf_dir, "nation")
    g = P.guard({"a": n, "b": n.orderBy(F.desc("n_name")), "c": n.withColumn("n_regionkey", F.col("n_regionkey") + 1)})
    return g.agg(F.count_distinct("digest").alias("different"), F.max(F.length("digest")).alias("digits"))


def nested_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"a":[{"b":'), F.col("props"), F.lit('}],"c":{"x":1}}')).alias("j"))
    return e.select("event_id", P.nested_value("j", "k").alias("k"))


def shard_phases(spark, sf_dir):
    """The phases of a shard with their quotas, and load samples besides."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    quotas = [("pilot", F.col("doc_id") % 50 == 0, 2, 1), ("repeat", (F.col("doc_id") % 10).isin(0, 1), 3, 3), ("holdout", F.col("doc_id") % 5 == 2, None, 1), ("broad", F.lit(True), 40, 1)]
    return P.phases(d, "doc_id", "source", quotas, SEED).unionByName(P.load_samples(d, "doc_id", [1, 4, 8, 16], 25, 10, SEED))


def option_subsets(spark, sf_dir):
    """A required option, confusers that depend on the row, others by hash, in canonical order."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    canonical = F.array(*(F.lit(f"Brand#{i}") for i in range(1, 26)))
    near = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Brand#1"), F.lit("Brand#2"))).otherwise(F.array(F.lit("Brand#3")))
    chosen = P.option_subset(F.array("p_brand"), near, F.array(*(F.lit(f"Brand#{i}") for i in range(4, 13))), canonical, 5, SEED, F.col("p_partkey"))
    return p.select("p_partkey", F.array_join(chosen, ",").alias("options"))


def micro_batches(spark, sf_dir):
    """Documents in batches of about one length; how many, how full."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    b = P.length_batches(d, "doc_id", F.greatest("n_chars", F.lit(1)), 4_096, 100_000_000, 512).groupBy("batch").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    return b


QUERIES = {f.__name__: f for f in (arms_joined, core_shard, label_quota, typo_noise, filler_candidates, deadline_admission, input_guard, nested_key, shard_phases, option_subsets, micro_batches)}

_K = f"sha256('{SEED}|' || {{}}::VARCHAR)"
ORACLE_SQL = {
    "arms_joined": """
        WITH f AS (SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2)
        SELECT a.user_id, a.v AS click, b.v AS purchase FROM f a JOIN f b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
    "core_shard": f"""
        WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS case_id, l_orderkey AS family, l_linenumber > 1 AS sib FROM lineitem),
        f AS (SELECT family FROM (SELECT family FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE sib) > 0) ORDER BY {_K.format('family')}, family LIMIT 40)
        SELECT case_id, 'counterfactual' AS phase FROM c WHERE family IN (SELECT family FROM f)
        UNION ALL SELECT case_id, 'holdout' FROM (SELECT case_id FROM c WHERE family % 5 = 0 ORDER BY {_K.format('case_id')}, case_id LIMIT 60)""",
    "label_quota": f"""
        WITH d AS (SELECT d.doc_id, lang, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
        w AS (SELECT *, count(*) FILTER (WHERE quality = 0) OVER (PARTITION BY lang) AS a, count(*) FILTER (WHERE quality <> 0) OVER (PARTITION BY lang) AS b,
          row_number() OVER (PARTITION BY lang, quality = 0 ORDER BY {_K.format('doc_id')}, doc_id) AS rn FROM d)
        SELECT doc_id, lang, quality FROM w WHERE rn <= least(a, b)""",
    "typo_noise": f"""
        WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM benchmark),
        h AS (SELECT *, ('0x' || substr(sha256('{SEED}|' || item_id::VARCHAR || '|' || i::VARCHAR || '|' || w), 1, 7))::BIGINT AS h, length(w) AS n FROM w),
        k AS (SELECT *, (h // 4) % greatest(n - 3, 1) + 2 AS k FROM h),
        s AS (SELECT item_id, i, CASE WHEN n >= 7 AND regexp_full_match(w, '[a-z]+') AND h % 4 = 0 THEN substr(w, 1, (k - 1)::INT) || substr(w, (k + 1)::INT, 1) || substr(w, k::INT, 1) || substr(w, (k + 2)::INT) ELSE w END AS w FROM k)
        SELECT item_id, string_agg(w, ' ' ORDER BY i) AS noisy FROM s GROUP BY 1""",
    "filler_candidates": """
        WITH p AS (SELECT c_nationkey AS k, count(DISTINCT c_name) AS size FROM customer GROUP BY 1)
        SELECT s_suppkey, least(3, size)::BIGINT AS n, least(3, size)::BIGINT AS different FROM supplier JOIN p ON s_nationkey = k""",
    "deadline_admission": """
        SELECT event_type, count(*) FILTER (WHERE ok)::BIGINT AS admitted, count(*) FILTER (WHERE NOT ok)::BIGINT AS refused
        FROM (SELECT event_type, epoch_ms(ts) + 1800000 <= epoch_ms(date_trunc('day', ts) + INTERVAL 23 HOUR) AS ok FROM events) GROUP BY 1""",
    # phase by phase, each over what the phases before it really took
    "shard_phases": f"""
        WITH d AS (SELECT doc_id, source, {_K.format('doc_id')} AS k FROM documents),
        p1 AS (SELECT doc_id FROM d WHERE doc_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY k, doc_id) <= 2),
        p2 AS (SELECT doc_id FROM d WHERE doc_id % 10 IN (1, 0) AND doc_id NOT IN (FROM p1) QUALIFY row_number() OVER (PARTITION BY source ORDER BY k, doc_id) <= 3),
        p3 AS (SELECT doc_id FROM d WHERE doc_id % 5 = 2 AND doc_id NOT IN (FROM p1) AND doc_id NOT IN (FROM p2)),
        p4 AS (SELECT doc_id FROM d WHERE doc_id NOT IN (FROM p1) AND doc_id NOT IN (FROM p2) AND doc_id NOT IN (FROM p3) QUALIFY row_number() OVER (PARTITION BY source ORDER BY k, doc_id) <= 40),
        l AS (SELECT doc_id FROM documents ORDER BY {_K.format('doc_id')}, doc_id LIMIT 25)
        SELECT doc_id, 'pilot' AS phase, 1::INTEGER AS rep FROM p1 UNION ALL SELECT doc_id, 'repeat', unnest([1, 2, 3])::INTEGER FROM p2 UNION ALL SELECT doc_id, 'holdout', 1 FROM p3 UNION ALL SELECT doc_id, 'broad', 1 FROM p4
        UNION ALL SELECT doc_id, phase, rep::INTEGER FROM l, (VALUES ('load_c1', 10), ('load_c4', 11), ('load_c8', 12), ('load_c16', 13)) v(phase, rep)""",
    "option_subsets": f"""
        WITH o AS (SELECT p_partkey, p_brand, p_size, unnest(list_transform(range(1, 26), lambda i: 'Brand#' || i)) AS o FROM part),
        g AS (SELECT *, CASE WHEN o = p_brand THEN 0 WHEN (p_size % 2 = 0 AND o IN ('Brand#1', 'Brand#2')) OR (p_size % 2 = 1 AND o = 'Brand#3') THEN 1
          WHEN split_part(o, '#', 2)::INT BETWEEN 4 AND 12 THEN 2 END AS kind FROM o),
        r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY kind, sha256('{SEED}|' || p_partkey::VARCHAR || '|' || o)) AS rn FROM g WHERE kind IS NOT NULL)
        SELECT p_partkey, string_agg(o, ',' ORDER BY split_part(o, '#', 2)::INT) AS options FROM r WHERE rn <= 5 GROUP BY 1""",
    "micro_batches": """
        WITH d AS (SELECT doc_id, least(ceil(greatest(coalesce(n_chars, 0), 1) / 512.0) * 512, 4096)::BIGINT AS top FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY sha256('batch|' || doc_id::VARCHAR), doc_id) - 1 AS rn, greatest(100000000 // (top * top), 1) AS each FROM d)
        SELECT top::VARCHAR || '-' || (rn // each)::VARCHAR AS batch, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM r GROUP BY 1""",
    "input_guard": "SELECT 2::BIGINT AS different, 64::INTEGER AS digits",
    "nested_key": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
}
