"""Paired queries: line items play trials of two arms, events repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.operators import paired as P
from ruleloom.sources.tables import table


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("stratum"), (F.col("l_returnflag") == "N").alias("a"), (F.col("l_linestatus") == "O").alias("b"), F.col("l_orderkey"))


def paired_contingency(spark, sf_dir):
    return P.contingency(_pairs(spark, sf_dir), ["stratum"], F.col("a"), F.col("b")).drop("p_value")


def mcnemar_by_group(spark, sf_dir):
    """Exact McNemar test of quality and absence of toxicity, by source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return P.contingency(rows, ["source"], F.col("quality") == 1, F.col("toxic") == 0)


def choice_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("a"), F.when(F.col("l_linestatus") == "F", F.lit("A")).alias("b"))
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")), 6).alias("agreement"))


def repeat_stability(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("choice"))
    s = P.stability(rows, "user_id", F.col("choice"))
    return s.select("user_id", "trials", "choices", (F.col("choices") == 1).alias("stable"))


def best_trial_pick(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    rows = table(spark, sf_dir, "events").select("user_id", rank.alias("rank"), "event_id", "event_type")
    return P.best_trial(rows, ["user_id"], ["rank", "event_id"], ["event_id", "event_type"])


def flip_sensitivity(spark, sf_dir):
    """Line 2 and later of an order are siblings of line 1."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("expected"), F.col("l_returnflag").alias("choice"))
    base = rows.where("l_linenumber = 1").select("l_orderkey", F.col("expected").alias("expected_base"), F.col("choice").alias("choice_base"))
    return P.flips(rows.where("l_linenumber > 1").join(base, "l_orderkey"), ["l_linenumber"])


QUERIES = {f.__name__: f for f in (paired_contingency, mcnemar_by_group, choice_agreement, repeat_stability, best_trial_pick, flip_sensitivity)}

_F = "count(*) FILTER (WHERE {})::BIGINT AS {}"
ORACLE_SQL = {
    "paired_contingency": f"""SELECT l_linenumber AS stratum, {_F.format("l_returnflag = 'N' AND l_linestatus = 'O'", "both")}, {_F.format("l_returnflag = 'N' AND l_linestatus <> 'O'", "only_a")},
        {_F.format("l_returnflag <> 'N' AND l_linestatus = 'O'", "only_b")}, {_F.format("l_returnflag <> 'N' AND l_linestatus <> 'O'", "neither")} FROM lineitem GROUP BY 1""",
    "mcnemar_by_group": f"""
        WITH j AS (SELECT source, quality = 1 AS a, toxic = 0 AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
        c AS (SELECT source, {_F.format("a AND b", "both")}, {_F.format("a AND NOT b", "only_a")}, {_F.format("NOT a AND b", "only_b")}, {_F.format("NOT a AND NOT b", "neither")} FROM j GROUP BY 1),
        k AS (SELECT source, only_a + only_b AS n, unnest(range(0, least(only_a, only_b) + 1)) AS i FROM c),
        p AS (SELECT source, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) AS tail FROM k WHERE n > 0 GROUP BY 1)
        SELECT c.*, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6)::DOUBLE AS p_value FROM c LEFT JOIN p ON c.source = p.source""",
    "choice_agreement": """
        SELECT l_linenumber, count(*)::BIGINT AS n, round(avg((a IS NOT DISTINCT FROM b)::INT::DOUBLE), 6) AS agreement
        FROM (SELECT l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS a, CASE WHEN l_linestatus = 'F' THEN 'A' END AS b FROM lineitem) GROUP BY 1""",
    "repeat_stability": """
        SELECT user_id, count(*)::BIGINT AS trials, count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type ELSE '<invalid>' END)::BIGINT AS choices,
          count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type ELSE '<invalid>' END) = 1 AS stable FROM events GROUP BY 1""",
    "best_trial_pick": """
        SELECT user_id, event_id, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, event_id) = 1""",
    "flip_sensitivity": f"""
        WITH p AS (SELECT s.l_linenumber, s.l_linestatus <> b.l_linestatus AS changed, s.l_returnflag IS DISTINCT FROM b.l_returnflag AS moved
          FROM lineitem s JOIN lineitem b ON s.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 WHERE s.l_linenumber > 1),
        a AS (SELECT l_linenumber, {_F.format("changed", "n_flip")}, {_F.format("changed AND moved", "flipped")}, {_F.format("NOT changed", "n_same")}, {_F.format("NOT changed AND NOT moved", "stayed")} FROM p GROUP BY 1)
        SELECT *, round(flipped::DOUBLE / nullif(n_flip, 0), 6) AS sensitivity, round(stayed::DOUBLE / nullif(n_same, 0), 6) AS invariance FROM a""",
}
