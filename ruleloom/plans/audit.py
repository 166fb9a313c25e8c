"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.functions import text as X
from ruleloom.operators import audit as A
from ruleloom.sources.tables import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.to_date("ts").alias("segment"))


def anti_join_missing(spark, sf_dir):
    """Documents that no label covers."""
    return A.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


def planned_and_present(spark, sf_dir):
    """Missing both ways, and shared, from one full outer join."""
    plan = table(spark, sf_dir, "documents").where("doc_id % 3 <> 1").select("doc_id", F.lit(True).alias("planned"))
    seen = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("present"))
    state = F.when(F.col("planned").isNull(), "unplanned").when(F.col("present").isNull(), "missing").otherwise("both")
    return plan.join(seen, "doc_id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def orphans(spark, sf_dir):
    """Customers without an order, by segment."""
    lone = A.missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])
    return lone.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("k").alias("least"))


def after_stop(spark, sf_dir):
    """Attempts more than two hours after their day's first purchase: an equal
    key and a range."""
    e = _events(spark, sf_dir)
    stops = e.where("event_type = 'purchase'").groupBy("segment").agg(F.min("ts").alias("stop"))
    late = e.where("event_type <> 'purchase'").join(stops, "segment").where(F.col("ts") > F.col("stop") + F.expr("INTERVAL 2 HOURS"))
    return late.groupBy(F.col("segment").cast("string").alias("segment")).agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


def asof_segment(spark, sf_dir):
    """Each error with the user's latest signup at or before it."""
    e = _events(spark, sf_dir)
    marks = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("signup_id"))
    return A.as_of(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), marks, "user_id", "ts", "signup_id", F.date_trunc("day", "ts")).select("event_id", "user_id", "signup_id")


def family_split_leak(spark, sf_dir):
    """Texts (families) that lie in both splits."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("family"))
    split = F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("dev")
    agg = d.groupBy("family").agg(F.count_distinct(split).alias("splits"), F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return agg.where("splits > 1").select("first_id", "n")


def uniqueness_audit(spark, sf_dir):
    """Repeated keys of three tables."""
    t = {"documents": ["doc_id"], "lineitem": ["l_orderkey", "l_linenumber"], "conversations": ["conv_id", "role"]}
    return A.report([A.duplicates(table(spark, sf_dir, name), keys).agg(F.lit(name).alias("table"), F.count("*").alias("repeated"), F.coalesce(F.max("n"), F.lit(0)).alias("most")) for name, keys in t.items()])


def hash_constancy(spark, sf_dir):
    """Priorities under which one customer's orders carry more than one status."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count_distinct(F.sha2("o_orderstatus", 256)).alias("hashes"))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("hashes") > 1).alias("inconstant"))


def leak_scan(spark, sf_dir):
    """Pages with forbidden words, by word, in one scan of the html."""
    low = F.lower("html")
    words = ["<script", "<iframe", "onclick", "password", "expected"]
    pairs = F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w))).alias("word")
    return table(spark, sf_dir, "pages").select("page_id", pairs).groupBy("word").agg(F.count("*").alias("n"), F.min("page_id").alias("least"))


def redacted_credentials(spark, sf_dir):
    """Documents that change when redacted, whole texts compared, and what is shown of them: two hundred characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", X.redact_whole(F.col("text")).alias("clean"))
    return d.where("text <> clean").select("doc_id", F.sha2(F.substring("clean", 1, 200), 256).alias("shown"))


def redacted_whole(spark, sf_dir):
    """Documents that change when redacted, with a digest of the whole redacted text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", X.redact_whole(F.col("text")).alias("clean"))
    return d.where("text <> clean").select("doc_id", F.sha2("clean", 256).alias("digest"))


def integrity_report(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return A.report([
        A.catalogue(o, "o_orderkey", [("price positive", F.col("o_totalprice") <= 0, True), ("status known", ~F.col("o_orderstatus").isin("O", "F", "P"), True), ("price under 400000", F.col("o_totalprice") > 400000, False)]),
        A.catalogue(li, "l_orderkey", [("discount at most 0.08", F.col("l_discount") > 0.08, False), ("quantity in range", ~F.col("l_quantity").between(1, 50), True)])])


QUERIES = {f.__name__: f for f in (anti_join_missing, planned_and_present, orphans, after_stop, asof_segment, family_split_leak, uniqueness_audit, hash_constancy, leak_scan, redacted_credentials, redacted_whole, integrity_report)}

_E = "SELECT event_id, ts, user_id, event_type, value, ts::DATE AS segment FROM events"


def _check(name, table_name, key, bad, hard):
    return f"""SELECT '{name}' AS "check", {hard} AS hard, (SELECT count(*) FROM {table_name})::BIGINT AS n_checked, (SELECT count(*) FROM {table_name} WHERE {bad})::BIGINT AS n_failed,
        coalesce((SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM (SELECT {key} AS k FROM {table_name} WHERE {bad} ORDER BY 1 LIMIT 25)), '') AS examples"""


_REDACTED = r"""
        WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'Bearer [A-Za-z0-9._~+/=-]+', '[redacted]', 'g'),
          'sk-[A-Za-z0-9_-]{8,}', '[redacted]', 'g'), '[0-9a-f]{32,}', '[redacted]', 'g'), '(?i)(api[_-]?key|token|secret)[ ]*[=:][ ]*[^ ]+', '[redacted]', 'g'),
          '(?i)("?authorization"?\s*[:=]\s*)("[^"]*"|(?:(?:basic|bearer|digest|negotiate|token)\s+)?[^\s,}]+)', '\1[redacted]', 'g') AS clean FROM documents)
        """
ORACLE_SQL = {
    "anti_join_missing": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "planned_and_present": """
        SELECT CASE WHEN p.doc_id IS NULL THEN 'unplanned' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'both' END AS state, count(*)::BIGINT AS n
        FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 1) p FULL JOIN labels l ON p.doc_id = l.doc_id GROUP BY 1""",
    "orphans": "SELECT c_mktsegment, count(*)::BIGINT AS n, min(c_custkey) AS least FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1",
    "after_stop": f"""
        WITH e AS ({_E}), s AS (SELECT segment, min(ts) AS stop FROM e WHERE event_type = 'purchase' GROUP BY 1)
        SELECT e.segment::VARCHAR AS segment, count(*)::BIGINT AS n, min(event_id) AS least FROM e JOIN s ON e.segment = s.segment AND e.ts > s.stop + INTERVAL 2 HOUR WHERE event_type <> 'purchase' GROUP BY e.segment""",
    "asof_segment": """
        SELECT e.event_id, e.user_id, m.signup_id FROM (SELECT * FROM events WHERE event_type = 'error') e
        ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS signup_id FROM events WHERE event_type = 'signup' GROUP BY 1, 2) m ON e.user_id = m.user_id AND e.ts >= m.ts""",
    "family_split_leak": """
        SELECT min(doc_id) AS first_id, count(*)::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT doc_id % 5 = 0) > 1""",
    "uniqueness_audit": """
        SELECT 'documents' AS "table", count(*)::BIGINT AS repeated, coalesce(max(n), 0)::BIGINT AS most FROM (SELECT count(*) AS n FROM documents GROUP BY doc_id HAVING n > 1)
        UNION ALL SELECT 'lineitem', count(*), coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING n > 1)
        UNION ALL SELECT 'conversations', count(*), coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id, role HAVING n > 1)""",
    "hash_constancy": """
        SELECT o_orderpriority, count(*)::BIGINT AS n, count(*) FILTER (WHERE h > 1)::BIGINT AS inconstant FROM (SELECT o_orderpriority, o_custkey, count(DISTINCT o_orderstatus) AS h FROM orders GROUP BY 1, 2) GROUP BY 1""",
    "leak_scan": """
        SELECT word, count(*)::BIGINT AS n, min(page_id) AS least FROM pages, (SELECT unnest(['<script', '<iframe', 'onclick', 'password', 'expected']) AS word) WHERE contains(lower(html), word) GROUP BY 1""",
    "redacted_credentials": _REDACTED + "SELECT doc_id, sha256(substr(clean, 1, 200)) AS shown FROM c WHERE text <> clean",
    "redacted_whole": _REDACTED + "SELECT doc_id, sha256(clean) AS digest FROM c WHERE text <> clean",
    "integrity_report": " UNION ALL ".join([
        _check("price positive", "orders", "o_orderkey", "o_totalprice <= 0", True), _check("status known", "orders", "o_orderkey", "o_orderstatus NOT IN ('O', 'F', 'P')", True),
        _check("price under 400000", "orders", "o_orderkey", "o_totalprice > 400000", False), _check("discount at most 0.08", "lineitem", "l_orderkey", "l_discount > 0.08", False),
        _check("quantity in range", "lineitem", "l_orderkey", "NOT l_quantity BETWEEN 1 AND 50", True)]),
}
