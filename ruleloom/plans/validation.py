"""Validation queries: answers are built from the events' properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.operators import validate as V
from ruleloom.sources.tables import table

KEYS = ["click", "error", "purchase"]


def _events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props", k.alias("k"))


def _answers(spark, sf_dir):
    """Some sound and some broken bodies, by the property k; numbers are quoted or boolean in some."""
    probabilities = F.when(F.col("k") % 7 == 1, '{"click":0.5,"error":0.5}').when(F.col("k") % 7 == 2, '{"click":0.2,"error":0.2,"purchase":0.2}').when(F.col("k") % 7 == 3, '{"click":2,"error":-1,"purchase":0}')
    probabilities = probabilities.when(F.col("k") % 7 == 4, '{"click":0.5,"error":0.25,"purchase":0.25,"x":0}').when(F.col("k") % 7 == 5, F.when(F.col("k") % 2 == 0, '{"click":"0.5","error":0.25,"purchase":0.25}').otherwise('{"click":true,"error":0,"purchase":0}'))
    probabilities = probabilities.when(F.col("k") % 7 == 6, F.when(F.col("k") % 2 == 0, '[0.5,0.5]').otherwise('{"click":1,"error":0,"purchase":0e0}')).otherwise('{"click":0.5,"error":0.25,"purchase":0.25}')
    sound = F.concat(F.lit('{"choice":"'), F.col("event_type"), F.lit('","confidence":'), F.when(F.col("k") % 11 == 0, "1.5").when(F.col("k") % 11 == 1, "true").when(F.col("k") % 11 == 2, '"0.6"').when(F.col("k") % 11 == 3, "null").when(F.col("k") % 11 == 4, "1").otherwise("0.75"), F.lit(',"probabilities":'), probabilities, F.lit("}"))
    body = F.when(F.col("k") % 13 == 0, "no json").when(F.col("k") % 13 == 1, "[1]").when(F.col("k") % 13 == 2, '{"confidence":1}').when(F.col("k") % 13 == 3, '{"choice":7}').otherwise(sound)
    return _events(spark, sf_dir).select("event_id", body.alias("body"))


def validate_decision_json(spark, sf_dir):
    reason = V.decision_reason(F.col("body"), F.array(*map(F.lit, KEYS)))
    return _answers(spark, sf_dir).select("event_id", F.coalesce(reason, F.lit("valid")).alias("reason"))


def validation_reasons(spark, sf_dir):
    return validate_decision_json(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


def validate_chat_json(spark, sf_dir):
    content = F.when(F.col("k") % 5 == 0, F.concat(F.lit("I choose "), F.col("event_type"))).when(F.col("k") % 5 == 1, F.concat(F.lit('{"choice":"'), F.col("event_type"), F.lit('","why":"x"}')))
    content = content.otherwise(F.concat(F.lit('{"choice":"'), F.col("event_type"), F.lit('"}')))
    rows = _events(spark, sf_dir).select("event_id", content.alias("content"))
    keys = F.array(*map(F.lit, KEYS))
    return rows.select("event_id", F.coalesce(V.chat_reason(F.col("content"), keys), F.lit("valid")).alias("strict"), V.lenient_choice(F.col("content"), keys).alias("lenient"))


def strict_against_lenient(spark, sf_dir):
    rows = validate_chat_json(spark, sf_dir)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("strict") == "valid").alias("n_strict"), F.count_if(F.col("lenient").isNotNull()).alias("n_lenient"),
                    F.count_if((F.col("strict") != "valid") & F.col("lenient").isNotNull()).alias("n_saved"))


QUERIES = {f.__name__: f for f in (validate_decision_json, validation_reasons, validate_chat_json, strict_against_lenient)}

_BODY = """
    WITH e AS (SELECT event_id, event_type AS t, json_extract_string(props, '$.k')::INT AS k FROM events),
    q AS (SELECT event_id, k, '{"choice":"' || t || '","confidence":' || CASE k % 11 WHEN 0 THEN '1.5' WHEN 1 THEN 'true' WHEN 2 THEN '"0.6"' WHEN 3 THEN 'null' WHEN 4 THEN '1' ELSE '0.75' END
      || ',"probabilities":' || CASE k % 7 WHEN 1 THEN '{"click":0.5,"error":0.5}' WHEN 2 THEN '{"click":0.2,"error":0.2,"purchase":0.2}' WHEN 3 THEN '{"click":2,"error":-1,"purchase":0}'
        WHEN 4 THEN '{"click":0.5,"error":0.25,"purchase":0.25,"x":0}' WHEN 5 THEN CASE WHEN k % 2 = 0 THEN '{"click":"0.5","error":0.25,"purchase":0.25}' ELSE '{"click":true,"error":0,"purchase":0}' END
        WHEN 6 THEN CASE WHEN k % 2 = 0 THEN '[0.5,0.5]' ELSE '{"click":1,"error":0,"purchase":0e0}' END ELSE '{"click":0.5,"error":0.25,"purchase":0.25}' END || '}' AS sound FROM e)
    SELECT event_id, CASE k % 13 WHEN 0 THEN 'no json' WHEN 1 THEN '[1]' WHEN 2 THEN '{"confidence":1}' WHEN 3 THEN '{"choice":7}' ELSE sound END AS body FROM q"""
_NUMBER = "json_type({j}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND {j}::DOUBLE BETWEEN 0 AND 1"
_DECISION = f"""
    WITH b AS (SELECT event_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM ({_BODY})),
    p AS (SELECT event_id, j, j->'$.choice' AS c, CASE WHEN json_type(j->'$.probabilities') = 'OBJECT' THEN j->'$.probabilities' END AS p, j->'$.confidence' AS s FROM b),
    v AS (SELECT *, json_keys(p) AS names, list_transform(json_keys(p), lambda n: json_extract(p, '$.' || n)) AS vals FROM p)
    SELECT event_id, CASE
      WHEN j IS NULL THEN 'not_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' WHEN c IS NULL OR json_type(c) = 'NULL' THEN 'choice_missing' WHEN json_type(c) <> 'VARCHAR' THEN 'choice_not_string'
      WHEN c->>'$' NOT IN ('click', 'error', 'purchase') THEN 'choice_not_offered' WHEN p IS NULL THEN 'probabilities_missing'
      WHEN NOT list_has_all(names, ['click', 'error', 'purchase']) THEN 'probability_key_missing' WHEN NOT list_has_all(['click', 'error', 'purchase'], names) THEN 'probability_key_extra'
      WHEN len(list_filter(vals, lambda x: NOT ({_NUMBER.format(j='x')}))) > 0 THEN 'probability_not_unit'
      WHEN abs(list_sum(list_transform(vals, lambda x: x::DOUBLE)) - 1) > 0.02 THEN 'probabilities_sum'
      WHEN s IS NULL OR NOT ({_NUMBER.format(j='s')}) THEN 'confidence_not_unit' ELSE 'valid' END AS reason FROM v"""
_CHAT = """
    WITH e AS (SELECT event_id, event_type AS t, json_extract_string(props, '$.k')::INT AS k FROM events)
    SELECT event_id, CASE WHEN k % 5 = 0 THEN 'not_json' WHEN k % 5 = 1 THEN 'extra_keys' WHEN t NOT IN ('click', 'error', 'purchase') THEN 'choice_not_offered' ELSE 'valid' END AS strict,
      CASE WHEN t IN ('click', 'error', 'purchase') THEN t END AS lenient FROM e"""
ORACLE_SQL = {
    "validate_decision_json": _DECISION,
    "validation_reasons": f"SELECT reason, count(*)::BIGINT AS n FROM ({_DECISION}) GROUP BY 1",
    "validate_chat_json": _CHAT,
    "strict_against_lenient": f"""SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE strict = 'valid')::BIGINT AS n_strict, count(lenient)::BIGINT AS n_lenient,
        count(*) FILTER (WHERE strict <> 'valid' AND lenient IS NOT NULL)::BIGINT AS n_saved FROM ({_CHAT})""",
}
