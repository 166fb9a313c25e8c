"""Look-up, planning and device queries that complete the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.functions import text as X
from ruleloom.operators import audit as A
from ruleloom.operators import lookup as L
from ruleloom.operators import sampling as M
from ruleloom.sources.tables import table


def attributes_with_default(spark, sf_dir):
    """Documents' label attributes, ? where there are none."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return L.with_default(d, table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


def template_fallback(spark, sf_dir):
    """Parts take the best pool by brand and type, then type, then brand, then any."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    keys = [F.concat_ws("/", "p_brand", "p_type"), F.concat(F.lit("*/"), F.col("p_type")), F.concat("p_brand", F.lit("/*"))]
    big = p.where("p_size >= 45")
    pool = big.groupBy(F.concat_ws("/", "p_brand", "p_type").alias("key")).agg(F.count("*").alias("pool")).where("pool >= 2")
    pool = pool.unionByName(big.where("p_size = 50").groupBy(F.concat("p_brand", F.lit("/*")).alias("key")).agg(F.count("*").alias("pool"))).unionByName(big.agg(F.lit("*/*").alias("key"), F.count("*").alias("pool")))
    return L.fallback(p, pool, "p_partkey", keys, "key", "pool", "*/*").select("p_partkey", "pool")


def case_coverage(spark, sf_dir):
    """Customers that don't have exactly one order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return L.coverage(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k").groupBy("n").agg(F.count("*").alias("customers"))


def foreign_key_checks(spark, sf_dir):
    li, lab = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "labels")
    found = L.foreign_keys(li, {"l_orderkey": (table(spark, sf_dir, "orders"), "o_orderkey"), "l_partkey": (table(spark, sf_dir, "part"), "p_partkey"), "l_suppkey": (table(spark, sf_dir, "supplier"), "s_suppkey")})
    return found.unionByName(L.foreign_keys(table(spark, sf_dir, "documents"), {"doc_id": (lab, "doc_id")}))


def cross_run_hashes(spark, sf_dir):
    """Documents whose normalised text differs from the raw one, as two runs."""
    d = table(spark, sf_dir, "documents")
    a, b = d.select("doc_id", F.sha2("text", 256).alias("h")), d.select("doc_id", F.sha2(F.regexp_replace("text", "[ ]{2,}", " "), 256).alias("h"))
    return L.hash_changes(a, b, "doc_id", "h")


def families_without_siblings(spark, sf_dir):
    """Documents whose text no other document has, by source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("family"))
    lone = d.groupBy("family").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("source").alias("source")).where("n = 1")
    return lone.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


def ambiguity_excluded(spark, sf_dir):
    """Rows with and without the ambiguous ones, in one pass."""
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("scored"), F.count_if(F.col("quality") == 1).alias("correct"))


def label_flips(spark, sf_dir):
    """Copies of one text whose labels differ from the first copy's."""
    j = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("family")).join(table(spark, sf_dir, "labels"), "doc_id")
    base = j.groupBy("family").agg(F.min_by(F.struct("doc_id", "quality", "toxic"), "doc_id").alias("b"))
    pairs = j.join(base, "family").where(F.col("doc_id") != F.col("b.doc_id"))
    return pairs.agg(F.count("*").alias("siblings"), F.count_if(F.col("quality") != F.col("b.quality")).alias("quality_flips"), F.count_if(F.col("toxic") != F.col("b.toxic")).alias("toxic_flips"))


def percentile_conventions(spark, sf_dir):
    """Three medians: nearest rank, the element at n // 2, and the mean of the middle two, from counts by value."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", F.col("l_quantity").cast("double").alias("v")).agg(F.count("*").alias("n"))
    return M.medians(counts, ["l_linenumber"], "v", "n")


def token_rates(spark, sf_dir):
    """Words a message by role, and messages whose count is over one in a hundred off a rough estimate."""
    words = F.size(F.split(F.trim(F.regexp_replace("text", "[ \t\r\n]+", " ")), " "))
    rows = table(spark, sf_dir, "conversations").select("role", words.alias("w"), F.expr("length(text) div 5").alias("guess"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum("w").alias("words"), F.round(F.avg("w"), 6).alias("mean"), F.count_if(F.abs(F.col("w") - F.col("guess")) * 100 > F.col("w")).alias("mismatched"))


def device_utilisation(spark, sf_dir):
    """Samples that are a list or one object: both become rows of devices."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]"))).otherwise(F.col("props")).alias("gpus"))
    listed = F.when(F.col("gpus").startswith("["), F.col("gpus")).otherwise(F.concat(F.lit("["), F.col("gpus"), F.lit("]")))
    each = e.select(F.posexplode(F.from_json(listed, "array<struct<k:int>>")).alias("device", "s"))
    return each.groupBy("device").agg(F.count("*").alias("n"), F.round(F.avg("s.k"), 6).alias("mean"), F.max("s.k").alias("most"))


def rank_fraction_split(spark, sf_dir):
    """The first fifth (rounded half to even) of each stratum's shuffled families to holdout."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", M.shuffle_key("plan-7", F.col("c_custkey")).alias("place"))
    held = M.ranked(c, ["c_mktsegment"], ["place"], M.hash_bucket(F.col("place")), "rn", "total").select("c_custkey", (F.col("rn") <= F.bround(0.2 * F.col("total"), 0)).alias("holdout"))
    return held.select("c_custkey", F.when(F.col("holdout"), "holdout").otherwise("dev").alias("split"))


def numbered_ids(spark, sf_dir):
    c = M.ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"], F.expr("c_custkey div 4096"), "rn")
    return c.select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit("-g-"), F.format_string("%06d", "rn")).alias("case_id"))


def holdout_only_strata(spark, sf_dir):
    """Strata that may never be in dev."""
    split = F.when(F.col("source").isin("src3", "src7"), "holdout").when(F.col("doc_id") % 5 == 0, "holdout").otherwise("dev")
    return table(spark, sf_dir, "documents").groupBy("source", split.alias("split")).agg(F.count("*").alias("n"))


def phase_union(spark, sf_dir):
    """Load phases and main phases in one plan, limited across phases in order."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    main = d.where("doc_id % 4 = 0").select("doc_id", F.lit(1).alias("phase_rank"), F.lit("broad").alias("phase"))
    load = d.where("doc_id % 9 = 0").select("doc_id", F.lit(2).alias("phase_rank"), F.lit("load_c4").alias("phase"))
    workers = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("phase", r"load_c(\d+)", 1), F.lit("")), F.lit("99")).cast("int"), F.lit(2))
    return main.unionByName(load).orderBy("phase_rank", "doc_id").limit(260).select("doc_id", "phase", workers.alias("concurrency"))


def key_sets(spark, sf_dir):
    """Missing, extra and equal keys of two sets for each nation's segments."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("have"))
    want = F.array(F.lit("AUTOMOBILE"), F.lit("BUILDING"), F.lit("OTHER"))
    return c.select("c_nationkey", F.array_join(F.array_sort(F.array_except(want, "have")), ",").alias("missing"), F.size(F.array_except("have", want)).alias("extra"), F.size(F.array_union("have", want)).alias("either"))


def date_shift(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), -1).alias("d"))
    return o.groupBy(F.date_format("d", "yyyy").alias("year")).agg(F.count("*").alias("n"), F.min(F.date_format("d", "MM/dd/yyyy")).alias("least"), F.max(F.date_format("d", "yyyy-MM-dd")).alias("most"))


def first_attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").cast("string").alias("segment"))
    return e.groupBy("segment").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), F.count("*").alias("n"))


def _named_twice(li):
    both = li.select(F.col("l_partkey").alias("k")).unionAll(li.select(F.col("l_suppkey").alias("k")))
    return A.duplicates(both, ["k"])


def referenced_twice(spark, sf_dir):
    """Ids that two columns together name more than once."""
    return _named_twice(table(spark, sf_dir, "lineitem"))


def referenced_twice_all(spark, sf_dir):
    """The same; it was the whole of referenced_twice when that was held to a part."""
    return referenced_twice(spark, sf_dir)


def name_variants(spark, sf_dir):
    """Names in three renderings that normalise to the same letters."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    same = X.alnum(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ."))) == X.alnum(F.col("n_name"))
    return n.select("n_nationkey", X.alnum(F.col("n_name")).alias("letters"), same.alias("same"))


QUERIES = {f.__name__: f for f in (attributes_with_default, template_fallback, case_coverage, foreign_key_checks, cross_run_hashes, families_without_siblings, ambiguity_excluded, label_flips, percentile_conventions,
                                   token_rates, device_utilisation, rank_fraction_split, numbered_ids, holdout_only_strata, phase_union, key_sets, date_shift, first_attempts, referenced_twice, referenced_twice_all, name_variants)}

_TWICE = "SELECT k, count(*)::BIGINT AS n FROM (SELECT l_partkey AS k FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY 1 HAVING count(*) > 1"
ORACLE_SQL = {
    "attributes_with_default": "SELECT d.doc_id, coalesce(quality::VARCHAR, '?') AS quality, coalesce(toxic::VARCHAR, '?') AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "template_fallback": """
        WITH b AS (SELECT * FROM part WHERE p_size >= 45), f AS (SELECT p_brand, p_type, count(*)::BIGINT AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 2), g AS (SELECT p_brand, count(*)::BIGINT AS n FROM b WHERE p_size = 50 GROUP BY 1)
        SELECT p_partkey, coalesce(f.n, g.n, (SELECT count(*) FROM b))::BIGINT AS pool FROM part p LEFT JOIN f ON p.p_brand = f.p_brand AND p.p_type = f.p_type LEFT JOIN g ON p.p_brand = g.p_brand""",
    "case_coverage": """
        SELECT n, count(*)::BIGINT AS customers FROM (SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) WHERE n <> 1 GROUP BY 1""",
    "foreign_key_checks": """
        SELECT 'l_orderkey' AS reference, count(*)::BIGINT AS n_dangling FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'l_suppkey', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT 'doc_id', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "cross_run_hashes": "SELECT doc_id FROM documents WHERE text <> regexp_replace(text, '[ ]{2,}', ' ', 'g')",
    "families_without_siblings": "SELECT source, count(*)::BIGINT AS n, min(doc_id) AS least FROM (SELECT min(source) AS source, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) = 1) GROUP BY 1",
    "ambiguity_excluded": """
        SELECT lang, count(*)::BIGINT AS n, count(quality)::BIGINT AS scored, count(*) FILTER (WHERE quality = 1)::BIGINT AS correct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
    "label_flips": """
        WITH j AS (SELECT d.doc_id, text, quality, toxic, min(d.doc_id) OVER (PARTITION BY text) AS f FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
        SELECT count(*)::BIGINT AS siblings, count(*) FILTER (WHERE j.quality <> b.quality)::BIGINT AS quality_flips, count(*) FILTER (WHERE j.toxic <> b.toxic)::BIGINT AS toxic_flips
        FROM j JOIN labels b ON b.doc_id = j.f WHERE j.doc_id <> j.f""",
    "percentile_conventions": """
        SELECT l_linenumber, quantile_disc(l_quantity, 0.5)::DOUBLE AS nearest, median(l_quantity)::DOUBLE AS middle, (list_sort(list(l_quantity)))[count(*) // 2 + 1] AS upper FROM lineitem GROUP BY 1""",
    "token_rates": r"""
        WITH w AS (SELECT role, len(string_split(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), ' ')) AS w, length(text) // 5 AS g FROM conversations)
        SELECT role, count(*)::BIGINT AS n, sum(w)::BIGINT AS words, round(avg(w), 6) AS mean, count(*) FILTER (WHERE abs(w - g) * 100 > w)::BIGINT AS mismatched FROM w GROUP BY 1""",
    "device_utilisation": """
        WITH k AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events), d AS (SELECT 0 AS device, k FROM k UNION ALL SELECT 1, k FROM k WHERE event_id % 2 = 0)
        SELECT device::INTEGER AS device, count(*)::BIGINT AS n, round(avg(k), 6) AS mean, max(k)::INTEGER AS most FROM d GROUP BY 1""",
    "rank_fraction_split": """
        WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('plan-7|' || c_custkey::VARCHAR)) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
        SELECT c_custkey, CASE WHEN rn <= round_even(0.2 * n, 0) THEN 'holdout' ELSE 'dev' END AS split FROM r""",
    "numbered_ids": "SELECT c_custkey, lower(c_mktsegment) || '-g-' || lpad((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey))::VARCHAR, 6, '0') AS case_id FROM customer",
    "holdout_only_strata": "SELECT source, CASE WHEN source IN ('src3', 'src7') OR doc_id % 5 = 0 THEN 'holdout' ELSE 'dev' END AS split, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2",
    "phase_union": """
        SELECT doc_id, phase, c::INTEGER AS concurrency FROM (SELECT doc_id, 1 AS r, 'broad' AS phase, 2 AS c FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 2, 'load_c4', 4 FROM documents WHERE doc_id % 9 = 0) ORDER BY r, doc_id LIMIT 260""",
    "key_sets": """
        WITH h AS (SELECT c_nationkey, list(DISTINCT c_mktsegment) AS have FROM customer GROUP BY 1), w AS (SELECT *, ['AUTOMOBILE', 'BUILDING', 'OTHER'] AS want FROM h)
        SELECT c_nationkey, array_to_string(list_sort(list_filter(want, lambda x: NOT list_contains(have, x))), ',') AS missing, len(list_filter(have, lambda x: NOT list_contains(want, x)))::INTEGER AS extra,
          len(list_distinct(list_concat(have, want)))::INTEGER AS either FROM w""",
    "date_shift": """
        WITH d AS (SELECT (o_orderdate::DATE - 1)::DATE AS d FROM orders)
        SELECT strftime(d, '%Y') AS year, count(*)::BIGINT AS n, min(strftime(d, '%m/%d/%Y')) AS least, max(strftime(d, '%Y-%m-%d')) AS most FROM d GROUP BY 1""",
    "first_attempts": "SELECT ts::DATE::VARCHAR AS segment, arg_min(event_id, (ts, event_id)) AS first_id, count(*)::BIGINT AS n FROM events GROUP BY ts::DATE",
    "referenced_twice": f"SELECT k, n FROM ({_TWICE})",
    "referenced_twice_all": f"SELECT k, n FROM ({_TWICE})",
    "name_variants": "SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS letters, true AS same FROM nation",
}
