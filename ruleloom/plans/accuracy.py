"""Accuracy queries: labels play outcomes, sources strata, languages workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.operators import accuracy as A
from ruleloom.sources.tables import table

def _ok():
    return F.col("quality") == 1


def cases(spark, sf_dir):
    """Labelled documents. Narrow columns only: the text is never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


def accuracy_by_stratum_wilson(spark, sf_dir):
    return A.by_stratum(cases(spark, sf_dir).withColumnRenamed("source", "stratum"), ["stratum"], _ok())


def accuracy_cube(spark, sf_dir):
    phase = F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("dev")
    rows = cases(spark, sf_dir).select(F.col("lang").alias("workflow"), F.col("source").alias("stratum"), phase.alias("phase"), "quality")
    return A.cube(rows, ["workflow", "stratum", "phase"], _ok())


def accuracy_two_scopes(spark, sf_dir):
    rows = cases(spark, sf_dir).select(F.col("lang").alias("workflow"), F.col("source").alias("stratum"), "quality")
    return A.scopes(rows, "workflow", "stratum", _ok())


def factor_slices(spark, sf_dir):
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    factors = {"lang": F.col("lang"), "length": size, "parity": F.col("doc_id") % 2, "toxic": F.col("toxic"), "third": F.col("doc_id") % 3}
    return A.factor_slices(cases(spark, sf_dir), factors, _ok())


def abstain_rates(spark, sf_dir):
    rows = cases(spark, sf_dir).withColumnRenamed("lang", "workflow")
    return A.abstention(rows, ["workflow"], F.col("quality") == 0, F.col("toxic") == 1)


def dataset_summary(spark, sf_dir):
    """Counts by language, source, split and label in one pass over the join."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    split = F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("dev")
    label = F.coalesce(F.col("quality").cast("string"), F.lit("?"))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in {"workflow": F.col("lang"), "stratum": F.col("source"), "split": split, "label": label}.items()))).alias("p")
    return rows.select(pairs).select("p.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def share_gates(spark, sf_dir):
    """Gates on shares: each is a row with its value and whether it holds."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 5 == 0).alias("held"))
    x = d.agg((F.sum("held") / F.sum("n")).alias("holdout"), F.count("*").cast("double").alias("strata"), F.min("n").cast("double").alias("least"))
    gate = lambda name, value, holds: F.struct(F.lit(name).alias("gate"), value.alias("value"), holds.alias("holds"))
    return x.select(F.explode(F.array(
        gate("holdout_share", F.round("holdout", 6), F.col("holdout").between(0.15, 0.25)),
        gate("stratum_count", F.col("strata"), F.col("strata") >= 10),
        gate("stratum_minimum", F.col("least"), F.col("least") >= 50))).alias("g")).select("g.*")


QUERIES = {f.__name__: f for f in (accuracy_by_stratum_wilson, accuracy_cube, accuracy_two_scopes, factor_slices, abstain_rates, dataset_summary, share_gates)}

_W = "(p + {z}*{z}/(2*m) {s} {z}*sqrt(p*(1-p)/m + {z}*{z}/(4*m*m))) / (1 + {z}*{z}/m)"
_LO, _HI = (_W.format(z=1.96, s=s) for s in "-+")
_LOX, _HIX = (_W.format(z=1.959963984540054, s=s) for s in "-+")
_CASES = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"

ORACLE_SQL = {
    "accuracy_by_stratum_wilson": f"""
        WITH a AS (SELECT source AS stratum, count(*)::BIGINT AS n, count(*) FILTER (WHERE quality = 1)::BIGINT AS correct FROM ({_CASES}) GROUP BY 1),
        b AS (SELECT *, correct::DOUBLE / n AS p, n::DOUBLE AS m FROM a)
        SELECT stratum, n, correct, round(p, 6) AS rate, round({_LO}, 6) AS ci_low, round({_HI}, 6) AS ci_high FROM b""",
    "accuracy_cube": f"""
        WITH c AS (SELECT lang AS workflow, source AS stratum, CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'dev' END AS phase, quality FROM ({_CASES})),
        a AS (SELECT CASE WHEN grouping(workflow) = 1 THEN 'ALL' ELSE workflow END AS workflow, CASE WHEN grouping(stratum) = 1 THEN 'ALL' ELSE stratum END AS stratum,
                CASE WHEN grouping(phase) = 1 THEN 'ALL' ELSE phase END AS phase, count(*)::BIGINT AS n, count(*) FILTER (WHERE quality = 1)::BIGINT AS correct
              FROM c GROUP BY CUBE (workflow, stratum, phase)),
        b AS (SELECT *, correct::DOUBLE / n AS p, n::DOUBLE AS m FROM a)
        SELECT workflow, stratum, phase, n, correct, round(p, 6) AS rate, round(greatest({_LOX}, 0), 6) AS ci_low, round(least({_HIX}, 1), 6) AS ci_high FROM b""",
    "accuracy_two_scopes": f"""
        SELECT CASE WHEN grouping(source) = 1 THEN 'workflow' ELSE 'workflow+stratum' END AS scope, lang AS workflow, source AS stratum, count(*)::BIGINT AS n,
          count(*) FILTER (WHERE quality = 1)::BIGINT AS correct, round(count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*), 6) AS rate
        FROM ({_CASES}) GROUP BY GROUPING SETS ((lang), (lang, source))""",
    "factor_slices": f"""
        WITH c AS ({_CASES}),
        f AS (SELECT quality, 'lang' AS factor, lang AS value FROM c
          UNION ALL SELECT quality, 'length', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END FROM c
          UNION ALL SELECT quality, 'parity', (doc_id % 2)::VARCHAR FROM c UNION ALL SELECT quality, 'toxic', toxic::VARCHAR FROM c
          UNION ALL SELECT quality, 'third', (doc_id % 3)::VARCHAR FROM c)
        SELECT factor, value, count(*)::BIGINT AS n, count(*) FILTER (WHERE quality = 1)::BIGINT AS correct,
          round(count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*), 6) AS rate FROM f GROUP BY 1, 2""",
    "abstain_rates": f"""
        WITH a AS (SELECT lang AS workflow, count(*) FILTER (WHERE toxic = 1)::BIGINT AS n_expected, count(*) FILTER (WHERE toxic = 1 AND quality = 0)::BIGINT AS n_abstained_right,
            count(*) FILTER (WHERE toxic <> 1)::BIGINT AS n_answerable, count(*) FILTER (WHERE toxic <> 1 AND quality = 0)::BIGINT AS n_over_abstained FROM ({_CASES}) GROUP BY 1),
        r AS (SELECT workflow, round(p, 6) AS abstain_rate, round({_LO}, 6) AS abstain_low FROM (SELECT workflow, n_abstained_right::DOUBLE / nullif(n_expected, 0) AS p, n_expected::DOUBLE AS m FROM a)),
        o AS (SELECT workflow, round(p, 6) AS over_rate, round({_HI}, 6) AS over_high FROM (SELECT workflow, n_over_abstained::DOUBLE / nullif(n_answerable, 0) AS p, n_answerable::DOUBLE AS m FROM a))
        SELECT a.*, r.abstain_rate, r.abstain_low, o.over_rate, o.over_high FROM a JOIN r USING (workflow) JOIN o USING (workflow)""",
    "dataset_summary": """
        WITH j AS (SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
        p AS (SELECT 'workflow' AS dimension, lang AS value FROM j UNION ALL SELECT 'stratum', source FROM j
          UNION ALL SELECT 'split', CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'dev' END FROM j UNION ALL SELECT 'label', coalesce(quality::VARCHAR, '?') FROM j)
        SELECT dimension, value, count(*)::BIGINT AS n FROM p GROUP BY 1, 2""",
    "share_gates": """
        WITH x AS (SELECT avg((doc_id % 5 = 0)::INT::DOUBLE) AS holdout, count(DISTINCT source)::DOUBLE AS strata FROM documents),
        m AS (SELECT min(n)::DOUBLE AS least FROM (SELECT count(*) AS n FROM documents GROUP BY source))
        SELECT 'holdout_share' AS gate, round(holdout, 6) AS value, holdout BETWEEN 0.15 AND 0.25 AS holds FROM x
        UNION ALL SELECT 'stratum_count', strata, strata >= 10 FROM x UNION ALL SELECT 'stratum_minimum', least, least >= 50 FROM m""",
}
