"""Rule routing queries: orders play results, parties charts, conversations inboxes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions import text as X
from ruleloom.operators import rules as R
from ruleloom.sources.tables import table


def _routed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    decision = R.first_match([
        ("status missing", X.blank_to_null(status).isNull(), "human_review"),
        ("conflict", (status == "P") & priority.startswith("1"), "human_review"),
        ("critical", priority.startswith("1") & (price >= 300000), "critical"),
        ("urgent", priority.startswith("1"), "urgent"),
        ("corrected", status == "P", "corrected"),
        ("preliminary", (status == "O") & (price < 50000), "preliminary"),
        ("outside", priority.startswith("5"), "outside"),
        ("by date", F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"), "archive")], ("default", "routine"))
    return o.select("o_orderkey", decision.alias("d")).select("o_orderkey", "d.choice", "d.reason")


def route_results_rules(spark, sf_dir):
    return _routed(spark, sf_dir)


def rule_fired_distribution(spark, sf_dir):
    n = F.count("*")
    agg = _routed(spark, sf_dir).groupBy("choice", "reason").agg(n.alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over one row for each rule
    return agg.select("choice", "reason", "n", F.round(F.col("n") / total, 6).alias("share"))


def offered_choice(spark, sf_dir):
    """Choices mapped to the options an item offers, with the abstain fallback."""
    options = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("critical"), F.lit("routine"), F.lit("human_review"))).otherwise(F.array(F.lit("urgent"), F.lit("routine"), F.lit("archive")))
    final = R.offered(F.col("choice"), options, F.lit("human_review"))
    rows = _routed(spark, sf_dir).select("choice", final.alias("final"))
    return rows.groupBy("choice", F.coalesce("final", F.lit("none")).alias("final")).agg(F.count("*").alias("n"))


def match_identity(spark, sf_dir):
    """Suppliers against customers of one nation and one tail of digits: exact
    keys block, edit distance decides."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nation"), F.substring(X.digits(F.col("c_name")), -3, 3).alias("tail"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"), F.substring(X.digits(F.col("s_name")), -3, 3).alias("tail"))
    near = F.levenshtein(X.digits(F.col("s_name")), X.digits(F.col("c_name"))) <= 1
    found = s.join(c, ["nation", "tail"]).where(near).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("c_custkey").alias("least"))
    decision = R.first_match([("one", F.col("n") == 1, F.col("least").cast("string")), ("several", F.col("n") > 1, "human_review")], ("none", "human_review"))
    return s.join(found, "s_suppkey", "left").select("s_suppkey", decision.alias("d")).select("s_suppkey", "d.choice", "d.reason")


def _newest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def newest_message(spark, sf_dir):
    """The newest user turn of each thread; older ones are never read."""
    return _newest(spark, sf_dir).select("conv_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"))


#: Destinations in order, with words that call for each.
INTENTS = [("greeting", "the "), ("list", " and "), ("origin", " of "), ("place", " la "), ("method", " der ")]


def _intents(sentence):
    s = F.concat(F.lit(" "), F.lower(sentence), F.lit(" "))
    chain = None
    for name, word in INTENTS:
        chain = F.when(s.contains(word), name) if chain is None else chain.when(s.contains(word), name)
    return chain


def sentence_intents(spark, sf_dir):
    """How often each destination is the first that a sentence of a newest message names."""
    each = _newest(spark, sf_dir).select(F.explode(X.sentences(F.col("text"))).alias("s"))
    return each.select(F.coalesce(_intents(F.col("s")), F.lit("none")).alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))


def route_inbox(spark, sf_dir):
    """No request, several destinations, or the one destination."""
    found = F.array_distinct(F.array_compact(F.transform(X.sentences(F.col("text")), _intents)))
    rows = _newest(spark, sf_dir).select("conv_id", found.alias("found"))
    decision = R.first_match([("no request", F.size("found") == 0, "human_review"), ("several", F.size("found") > 1, "human_review")], ("one", F.try_element_at("found", F.lit(1))))
    return rows.select("conv_id", decision.alias("d")).select("conv_id", "d.choice", "d.reason")


QUERIES = {f.__name__: f for f in (route_results_rules, rule_fired_distribution, offered_choice, match_identity, newest_message, sentence_intents, route_inbox)}

_ROUTED = """
    SELECT o_orderkey, CASE
      WHEN o_orderstatus IS NULL OR trim(o_orderstatus) = '' THEN 'human_review|status missing'
      WHEN o_orderstatus = 'P' AND starts_with(o_orderpriority, '1') THEN 'human_review|conflict'
      WHEN starts_with(o_orderpriority, '1') AND o_totalprice >= 300000 THEN 'critical|critical'
      WHEN starts_with(o_orderpriority, '1') THEN 'urgent|urgent'
      WHEN o_orderstatus = 'P' THEN 'corrected|corrected'
      WHEN o_orderstatus = 'O' AND o_totalprice < 50000 THEN 'preliminary|preliminary'
      WHEN starts_with(o_orderpriority, '5') THEN 'outside|outside'
      WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'archive|by date' ELSE 'routine|default' END AS d FROM orders"""
_NEWEST = "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1"
_SENTENCES = r"""
    SELECT conv_id, trim(regexp_replace(s, '[ \t\r\n\f]+', ' ', 'g')) AS s FROM (
      SELECT conv_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.?!])[ \t\r\n]+', '\1' || chr(1), 'g'), '[ \t]{2,}', chr(1), 'g'), chr(1))) AS s FROM (""" + _NEWEST + """))
    WHERE trim(regexp_replace(s, '[ \\t\\r\\n\\f]+', ' ', 'g')) <> ''"""
_INTENT = "CASE " + " ".join(f"WHEN contains(' ' || lower(s) || ' ', '{w}') THEN '{n}'" for n, w in INTENTS) + " END"

ORACLE_SQL = {
    "route_results_rules": f"SELECT o_orderkey, split_part(d, '|', 1) AS choice, split_part(d, '|', 2) AS reason FROM ({_ROUTED})",
    "rule_fired_distribution": f"""
        SELECT split_part(d, '|', 1) AS choice, split_part(d, '|', 2) AS reason, count(*)::BIGINT AS n,
          round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 6) AS share FROM ({_ROUTED}) GROUP BY 1, 2""",
    "offered_choice": f"""
        WITH r AS (SELECT o_orderkey, split_part(d, '|', 1) AS choice FROM ({_ROUTED})),
        f AS (SELECT choice, CASE WHEN o_orderkey % 3 = 0 THEN (CASE WHEN choice IN ('critical', 'routine', 'human_review') THEN choice ELSE 'human_review' END)
          WHEN choice IN ('urgent', 'routine', 'archive') THEN choice ELSE 'none' END AS final FROM r)
        SELECT choice, final, count(*)::BIGINT AS n FROM f GROUP BY 1, 2""",
    "match_identity": """
        WITH c AS (SELECT c_custkey, c_nationkey AS nation, regexp_replace(c_name, '[^0-9]', '', 'g') AS d FROM customer),
        s AS (SELECT s_suppkey, s_nationkey AS nation, regexp_replace(s_name, '[^0-9]', '', 'g') AS d FROM supplier),
        f AS (SELECT s_suppkey, count(*) AS n, min(c_custkey) AS least FROM s JOIN c ON s.nation = c.nation AND right(s.d, 3) = right(c.d, 3) AND levenshtein(s.d, c.d) <= 1 GROUP BY 1)
        SELECT s.s_suppkey, CASE WHEN n = 1 THEN least::VARCHAR ELSE 'human_review' END AS choice,
          CASE WHEN n = 1 THEN 'one' WHEN n > 1 THEN 'several' ELSE 'none' END AS reason FROM s LEFT JOIN f ON s.s_suppkey = f.s_suppkey""",
    "newest_message": f"SELECT conv_id, length(text)::BIGINT AS n_chars, sha256(text) AS digest FROM ({_NEWEST})",
    "sentence_intents": f"SELECT coalesce({_INTENT}, 'none') AS intent, count(*)::BIGINT AS n FROM ({_SENTENCES}) GROUP BY 1",
    "route_inbox": f"""
        WITH f AS (SELECT c.conv_id, count(DISTINCT i.intent) AS n, min(i.intent) AS one FROM ({_NEWEST}) c LEFT JOIN (SELECT conv_id, {_INTENT} AS intent FROM ({_SENTENCES})) i
          ON c.conv_id = i.conv_id GROUP BY 1)
        SELECT conv_id, CASE WHEN n = 1 THEN one ELSE 'human_review' END AS choice, CASE WHEN n = 0 THEN 'no request' WHEN n > 1 THEN 'several' ELSE 'one' END AS reason FROM f""",
}
