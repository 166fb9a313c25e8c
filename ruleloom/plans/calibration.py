"""Calibration queries: sums of every tenth component of embeddings play ten options."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.functions import text as X
from ruleloom.operators import calibration as C
from ruleloom.operators import validate as V
from ruleloom.sources.tables import table

STEPS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _scored(spark, sf_dir):
    """(vec_id, label, choice, p): softmax choice and its probability, worked out once for
    each row: a sum looks at its own components, and the row is made by a generator,
    into which the optimizer doesn't copy what later steps read twice."""
    x = F.col("embedding")
    tenth = lambda k: F.transform(F.sequence(k, F.greatest(k, F.size(x) - 1), F.lit(10)), lambda i: F.coalesce(F.get(x, i).cast("double"), F.lit(0.0)))
    sums = F.transform(F.array(*(F.lit(k) for k in range(10))), lambda k: F.aggregate(tenth(k), F.lit(0.0), lambda a, v: a + v))
    keys = F.array(*(F.lit(i) for i in range(10)))
    scored = X.bound(X.bound(sums, lambda v: C.softmax(v, 10.0)), lambda p: F.struct(V.argmax_key(p, keys).alias("choice"), F.array_max(p).alias("p")))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.inline(F.array(scored)))


def _right():
    return F.col("choice") == F.col("label")


def argmax_choice(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "label", "choice", F.round("p", 6).alias("p"))


def selective_accuracy(spark, sf_dir):
    return C.selective(_scored(spark, sf_dir), [], F.col("p"), _right(), STEPS)


def selective_by_parity(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("part", F.col("vec_id") % 2)
    return C.selective(rows, ["part"], F.col("p"), _right(), STEPS)


def reliability_bins(spark, sf_dir):
    r = C.reliability(_scored(spark, sf_dir), [], F.col("p"), _right())
    return r.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def ece_by_label(spark, sf_dir):
    return C.ece(_scored(spark, sf_dir), ["label"], F.col("p"), _right())


def overconfident_errors(spark, sf_dir):
    return C.confidence_split(_scored(spark, sf_dir), ["choice"], F.col("p"), _right(), 0.5)


def binary_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", V.binary_confidence(F.col("l_discount") * 10).alias("c"))
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.min("c"), 6).alias("least"))


QUERIES = {f.__name__: f for f in (argmax_choice, selective_accuracy, selective_by_parity, reliability_bins, ece_by_label, overconfident_errors, binary_confidence)}

_S = """
    SELECT vec_id, label, (list_position(p, list_max(p)) - 1)::INTEGER AS choice, list_max(p) AS p FROM (
      SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (
        SELECT vec_id, label, list_transform(v, lambda x: exp((x - list_max(v)) * 10.0)) AS e FROM (
          SELECT vec_id, label, list_transform(range(1, 11), lambda k: list_sum(list_transform(list_slice(embedding, k, len(embedding), 10), lambda x: x::DOUBLE))) AS v FROM embeddings)))"""
_SEL = """SELECT {k} t.threshold, count(*)::BIGINT AS n, count(*) FILTER (WHERE p >= t.threshold)::BIGINT AS covered, count(*) FILTER (WHERE p >= t.threshold AND choice = label)::BIGINT AS correct,
    round(count(*) FILTER (WHERE p >= t.threshold)::DOUBLE / count(*), 6) AS coverage,
    round(count(*) FILTER (WHERE p >= t.threshold AND choice = label)::DOUBLE / nullif(count(*) FILTER (WHERE p >= t.threshold), 0), 6) AS accuracy
    FROM (""" + _S + """) s, (SELECT unnest([""" + ", ".join(f"{x}::DOUBLE" for x in STEPS) + """]) AS threshold) t GROUP BY ALL"""
ORACLE_SQL = {
    "argmax_choice": f"SELECT vec_id, label, choice, round(p, 6) AS p FROM ({_S})",
    "selective_accuracy": _SEL.format(k=""),
    "selective_by_parity": _SEL.format(k="vec_id % 2 AS part,"),
    "reliability_bins": f"SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*)::BIGINT AS n, round(avg(p), 6) AS confidence, round(avg((choice = label)::INT::DOUBLE), 6) AS accuracy FROM ({_S}) GROUP BY 1",
    "ece_by_label": f"""
        WITH r AS (SELECT label, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg((choice = label)::INT::DOUBLE) AS a FROM ({_S}) GROUP BY 1, 2)
        SELECT label, sum(n)::BIGINT AS n, round(sum(n * abs(c - a)) / sum(n), 6)::DOUBLE AS ece FROM r GROUP BY 1""",
    "overconfident_errors": f"""
        SELECT choice, count(*)::BIGINT AS n, round(avg(p) FILTER (WHERE choice = label), 6) AS right_mean, round(avg(p) FILTER (WHERE choice <> label), 6) AS wrong_mean,
          count(*) FILTER (WHERE choice <> label AND p >= 0.5)::BIGINT AS overconfident FROM ({_S}) GROUP BY 1""",
    "binary_confidence": """
        SELECT l_linenumber, count(*)::BIGINT AS n, round(avg(greatest(l_discount * 10, 1 - l_discount * 10)), 6) AS mean, round(min(greatest(l_discount * 10, 1 - l_discount * 10)), 6) AS least
        FROM lineitem GROUP BY 1""",
}
