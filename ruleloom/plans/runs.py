"""Attempt chains and bodies compared: order lines play attempts, orders play cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.operators import attempts as T
from ruleloom.operators import bodies as B
from ruleloom.sources.tables import table

#: Of an attempt, by trial k, number no, part p and supplier s: text that both engines read.
STATUS = "CASE p % 16 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 422 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 200 WHEN 6 THEN NULL WHEN 7 THEN 201 WHEN 8 THEN 429 WHEN 9 THEN 429 ELSE 503 END"
ERROR = "CASE p % 16 WHEN 3 THEN 'timeout' WHEN 4 THEN 'network_error: reset' WHEN 5 THEN 'bad_json' WHEN 6 THEN 'aborted' WHEN 9 THEN 'http_429' END"
BEGIN = "CAST(CASE no WHEN 1 THEN 0 WHEN 2 THEN 2100000 WHEN 3 THEN 7200000 ELSE 7200000 + 5000000 * (no - 3) END + CASE WHEN s % 17 = 0 THEN 900000 WHEN s % 19 = 0 THEN -500000 ELSE 0 END + 60000000 * k AS BIGINT)"


def _attempts(spark, sf_dir):
    """(k, no, p, s, b, e, segment, kind)"""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    rows = li.withColumn("b", F.expr(BEGIN)).withColumn("e", F.col("b") + 1_000_000).withColumn("segment", F.expr("k div 100"))
    return rows.withColumn("kind", T.outcome_class(F.expr(STATUS), F.expr(ERROR)))


def attempt_chains(spark, sf_dir):
    """Every trial's chain of attempts: its outcome and each way in which it broke the rules of retrying."""
    return T.chains(_attempts(spark, sf_dir), ["k"], "no", F.col("kind"), "b", "e").withColumnRenamed("k", "trial")


def chain_outcomes(spark, sf_dir):
    """Chains by outcome, how many of them are sound, and their attempts."""
    return attempt_chains(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("sound").alias("n_sound"), F.sum("attempts").alias("attempts"))


def after_fatal_status(spark, sf_dir):
    """Attempts that began after a fatal status had stopped their segment, by segment."""
    late = T.after_fatal(_attempts(spark, sf_dir), "segment", F.col("kind"), "b", "e")
    return late.groupBy("segment").agg(F.count("*").alias("n"), F.min("stopped_us").alias("stopped_us"), F.max("b").alias("latest_us"))


_ORDER = """'"order":{"status":"' || s || '","tier":["' || p || '",{"deep":{"er":[' || (k % 9) || ',[]]}}]}'"""
LEFT = f"""CASE WHEN k % 23 = 0 THEN NULL WHEN k % 29 = 0 THEN 'no json ' || k ELSE '{{"id":' || k || ',' || {_ORDER} || ',"note":null,"tags":[1,2.50,"x"],"none":{{}}}}' END"""
RIGHT = f"""CASE k % 11 WHEN 0 THEN NULL
  WHEN 1 THEN '{{"tags": [1, 2.50, "x"], "none": {{}}, "note": null, "id": ' || k || ', ' || {_ORDER} || '}}'
  WHEN 2 THEN '{{"id":' || (k + 1) || ',' || {_ORDER} || ',"note":null,"tags":[1,2.50,"x"],"none":{{}}}}'
  WHEN 3 THEN '{{"id":' || k || ',' || {_ORDER} || ',"tags":[1,2.50,"x"],"none":{{}}}}'
  WHEN 4 THEN '{{"id":' || k || ',' || {_ORDER} || ',"note":null,"tags":[1,2.50,"x","y",{{"z":true}}],"none":{{}}}}'
  WHEN 5 THEN '{{"id":"' || k || '",' || {_ORDER} || ',"note":"","tags":[],"none":[]}}'
  WHEN 6 THEN 'no json ' || k
  WHEN 7 THEN '{{"id":' || k || ',"order":{{"status":"' || s || '","tier":["' || p || '",{{"deep":{{"er":[' || (k % 8) || ',[]]}}}}]}},"note":null,"tags":[1,2.50,"x"],"none":{{}}}}'
  WHEN 8 THEN '[' || k || ']'
  ELSE '{{"id":' || k || ',' || {_ORDER} || ',"note":null,"tags":[1,2.50,"x"],"none":{{}}}}' END"""


def body_differences(spark, sf_dir):
    """Bodies that two makers wrote for an order, where they aren't the same, with the first place."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    return B.differences(o.select("k", F.expr(LEFT).alias("body")), o.select("k", F.expr(RIGHT).alias("body")), "k", "body").withColumnRenamed("k", "o_orderkey")


QUERIES = {f.__name__: f for f in (attempt_chains, chain_outcomes, after_fatal_status, body_differences)}

_KIND = f"""SELECT k, no, b, b + 1000000 AS e, k // 100 AS segment, CASE WHEN why = 'aborted' THEN 'aborted' WHEN st IN (429, 503) OR why IN ('timeout', 'network_error: reset') THEN 'retryable' WHEN st = 404 THEN 'fatal'
      WHEN st IN (200, 201) AND why IS NULL THEN 'ok' ELSE 'final' END AS kind
    FROM (SELECT l_orderkey AS k, l_linenumber AS no, l_partkey AS p, l_suppkey AS s, {STATUS} AS st, {ERROR} AS why, {BEGIN} AS b FROM lineitem)"""
_CHAINS = f"""
    WITH a AS ({_KIND}), r AS (SELECT *, row_number() OVER (PARTITION BY k, no ORDER BY b, e, kind) AS nth, count(*) OVER (PARTITION BY k, no) AS copies FROM a),
    c AS (SELECT *, lag(no) OVER w AS pn, lag(kind) OVER w AS pk, lag(e) OVER w AS pe, row_number() OVER (PARTITION BY k ORDER BY no DESC) AS from_last FROM r WHERE nth = 1 WINDOW w AS (PARTITION BY k ORDER BY no)),
    d AS (SELECT *, pn IS NOT NULL AND pn = no - 1 AS follows, CASE no WHEN 2 THEN 1000000 WHEN 3 THEN 4000000 END AS due FROM c),
    g AS (SELECT k, sum(copies)::BIGINT AS attempts, max(no)::BIGINT AS last_number, max(kind) FILTER (WHERE from_last = 1) AS last, count(*) FILTER (WHERE copies > 1)::BIGINT AS repeated, count(*) FILTER (WHERE no < 1 OR (no > 1 AND NOT follows))::BIGINT AS gaps,
      count(*) FILTER (WHERE follows AND pk <> 'retryable')::BIGINT AS unasked, count(*) FILTER (WHERE no > 3)::BIGINT AS beyond, count(*) FILTER (WHERE follows AND b - pe < due)::BIGINT AS early, count(*) FILTER (WHERE follows AND b - pe > due + 750000)::BIGINT AS late FROM d GROUP BY k)
    SELECT k AS trial, attempts, last_number, CASE WHEN last <> 'retryable' THEN last WHEN last_number > 2 THEN 'exhausted' ELSE 'cut_short' END AS outcome, repeated, gaps, unasked, beyond, early, late,
      repeated = 0 AND gaps = 0 AND unasked = 0 AND beyond = 0 AND early = 0 AND late = 0 AS sound FROM g"""


def _leaves(name):
    """Leaves by DuckDB's own walk over a tree."""
    return f"""SELECT k, j.fullkey AS path, j.value::VARCHAR AS value FROM (SELECT k, {name}::JSON AS body FROM t WHERE json_valid({name})) x, json_tree(x.body) j
        WHERE j.type NOT IN ('OBJECT', 'ARRAY') OR j.value::VARCHAR IN ('{{}}', '[]') UNION ALL SELECT k, '$', {name} FROM t WHERE {name} IS NOT NULL AND NOT json_valid({name})"""


ORACLE_SQL = {
    "attempt_chains": _CHAINS,
    "chain_outcomes": f"SELECT outcome, count(*)::BIGINT AS n, count(*) FILTER (WHERE sound)::BIGINT AS n_sound, sum(attempts)::BIGINT AS attempts FROM ({_CHAINS}) GROUP BY 1",
    "after_fatal_status": f"""
        WITH a AS ({_KIND}), s AS (SELECT *, min(e) FILTER (WHERE kind = 'fatal') OVER (PARTITION BY segment) AS stopped FROM a)
        SELECT segment, count(*)::BIGINT AS n, min(stopped) AS stopped_us, max(b) AS latest_us FROM s WHERE b > stopped + 2000000 GROUP BY 1""",
    "body_differences": f"""
        WITH t AS (SELECT k, {LEFT} AS a, {RIGHT} AS b FROM (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders)),
        l AS ({_leaves('a')}), r AS ({_leaves('b')}),
        d AS (SELECT coalesce(l.k, r.k) AS k, coalesce(l.path, r.path) AS path, l.value AS lv, r.value AS rv FROM l FULL JOIN r ON l.k = r.k AND l.path = r.path WHERE l.value IS DISTINCT FROM r.value)
        SELECT d.k AS o_orderkey, CASE WHEN any_value(t.b) IS NULL THEN 'left_only' WHEN any_value(t.a) IS NULL THEN 'right_only' ELSE 'differs' END AS state, count(*)::BIGINT AS n_differing,
          min(path) AS first_path, (list(lv ORDER BY path))[1] AS left_value, (list(rv ORDER BY path))[1] AS right_value FROM d JOIN t ON d.k = t.k GROUP BY d.k""",
}
