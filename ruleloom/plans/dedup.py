"""Duplicate, vocabulary and contamination queries, and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.functions import text as X
from ruleloom.operators import dedup as D
from ruleloom.sources.tables import table


def dedup_by_hash(spark, sf_dir):
    return D.by_hash(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def strip_injections(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html"), X.strip_comments(F.col("html")).alias("clean"))
    return p.select("page_id", (F.length("html") - F.length("clean")).cast("long").alias("stripped"), F.sha2("clean", 256).alias("digest"))


def near_miss_blocked(spark, sf_dir):
    """Suppliers and customers whose digits are one edit apart; words meet on what is left of them without one letter."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    s = table(spark, sf_dir, "supplier").select(digits(F.col("s_name")).alias("a"))
    c = table(spark, sf_dir, "customer").select(digits(F.col("c_name")).alias("b"))
    return D.one_edit_pairs(s, c, "a", "b").groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("least"))


def near_miss_all(spark, sf_dir):
    """The same; it was the whole of near_miss_blocked when that was held to a part."""
    return near_miss_blocked(spark, sf_dir)


def _words(df, text, name):
    return df.select(F.explode(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")), " ")).alias(name)).where(F.length(name) >= 5)


def typo_normalize(spark, sf_dir):
    """Benchmark words unknown to frequent words of conversations that have one neighbour among them."""
    vocabulary = _words(table(spark, sf_dir, "conversations"), F.col("text"), "word").groupBy("word").agg(F.count("*").alias("n")).where("n >= 20").select("word")
    words = _words(table(spark, sf_dir, "benchmark"), F.col("text"), "word").distinct()
    return D.unique_corrections(words, vocabulary, "word")


def benchmark_overlap(spark, sf_dir):
    """Items contained in documents, of any length; texts are read once and stay where they are."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return D.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", items, "item_id", "text")


def date_normalize(spark, sf_dir):
    """Order dates written in three formats (and one broken) and read again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.date_format("d", "yyyy-MM-dd")).when(k == 1, F.date_format("d", "M/d/yyyy")).when(k == 2, F.date_format("d", "MMMM d, yyyy")).otherwise(F.concat(F.lit("on "), F.date_format("d", "yyyy-MM-dd")))
    read = X.parse_date(written)
    return o.select(F.date_format("d", "yyyy-MM").alias("month"), k.alias("k"), read.alias("r"), "d").groupBy("month", "k").agg(F.count("*").alias("n"), F.count("r").alias("read"), F.count_if(F.col("r") == F.col("d")).alias("equal"))


def person_parse(spark, sf_dir):
    """Names written both ways and with an initial are one person."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    last = F.concat(F.lit("o'"), F.lower("c_mktsegment"))
    a = F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" Q. "), last)
    b = F.concat(last, F.lit(", "), F.lower("c_mktsegment"))
    p = X.person(a)
    return c.select("c_custkey", p["first"].alias("first"), p["last"].alias("last"), X.same_person(a, b, 0).alias("same"))


def template_fill(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    t = F.lit("{name} ({id}) of region {region}; {name}")
    return n.select("n_nationkey", X.fill(t, {"name": F.initcap("n_name"), "id": F.col("n_nationkey").cast("string"), "region": F.col("n_regionkey").cast("string")}).alias("text"))


def spread_words(spark, sf_dir):
    """The documents' words, by the first document that has them, each two edits and more from all that are kept before it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return D.spread(d.groupBy("word").agg(F.min("doc_id").alias("first")), "word", ["first"])


QUERIES = {f.__name__: f for f in (dedup_by_hash, strip_injections, near_miss_blocked, near_miss_all, typo_normalize, benchmark_overlap, date_normalize, person_parse, template_fill, spread_words)}

_PAIRS = """(SELECT DISTINCT regexp_replace(s_name, '[^0-9]', '', 'g') AS a FROM supplier) s JOIN (SELECT DISTINCT regexp_replace(c_name, '[^0-9]', '', 'g') AS b FROM customer) c ON damerau_levenshtein(a, b) <= 1"""
_WORDS = "SELECT unnest(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) AS word FROM {}"
ORACLE_SQL = {
    "dedup_by_hash": "SELECT min(doc_id) AS kept_id, count(*)::BIGINT AS copies FROM documents GROUP BY text",
    "strip_injections": r"""
        WITH p AS (SELECT page_id, html, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS clean FROM pages)
        SELECT page_id, (length(html) - length(clean))::BIGINT AS stripped, sha256(clean) AS digest FROM p""",
    "near_miss_blocked": f"SELECT a, count(*)::BIGINT AS n, min(b) AS least FROM {_PAIRS} GROUP BY 1",
    "near_miss_all": f"SELECT a, count(*)::BIGINT AS n, min(b) AS least FROM {_PAIRS} GROUP BY 1",
    "typo_normalize": f"""
        WITH v AS (SELECT word FROM ({_WORDS.format('conversations')}) WHERE length(word) >= 5 GROUP BY 1 HAVING count(*) >= 20),
        u AS (SELECT DISTINCT word FROM ({_WORDS.format('benchmark')}) WHERE length(word) >= 5 AND word NOT IN (SELECT word FROM v)),
        p AS (SELECT u.word, v.word AS correction FROM u JOIN v ON abs(length(u.word) - length(v.word)) <= 1 AND damerau_levenshtein(u.word, v.word) <= 1)
        SELECT word, min(correction) AS correction FROM p GROUP BY 1 HAVING count(*) = 1""",
    "benchmark_overlap": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "date_normalize": """
        SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey % 4 AS k, count(*)::BIGINT AS n, count(*) FILTER (WHERE o_orderkey % 4 < 3)::BIGINT AS read,
          count(*) FILTER (WHERE o_orderkey % 4 < 3)::BIGINT AS equal FROM orders GROUP BY 1, 2""",
    # one word after the other: it falls if a near one before it has not fallen
    "spread_words": """
        WITH p AS (SELECT word, min(doc_id) AS first FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1),
        n AS (SELECT word, first, row_number() OVER (ORDER BY first, word) AS i FROM p),
        d AS (SELECT i, word, unnest(list_distinct(list_append(list_transform(range(1, length(word) + 1), lambda k: substr(word, 1, (k - 1)::INT) || substr(word, (k + 1)::INT)), word))) AS d FROM n),
        g AS (SELECT v AS i, list(u) AS us FROM (SELECT DISTINCT a.i AS u, b.i AS v FROM d a JOIN d b ON a.d = b.d AND a.i < b.i WHERE levenshtein(a.word, b.word) <= 1) GROUP BY 1),
        f AS (SELECT list_reduce(list_prepend({'i': 0::BIGINT, 'us': []::BIGINT[], 'out': []::BIGINT[]}, list({'i': i, 'us': us, 'out': []::BIGINT[]} ORDER BY i)),
          lambda s, x: {'i': x.i, 'us': []::BIGINT[], 'out': CASE WHEN length(list_filter(x.us, lambda u: NOT list_contains(s.out, u))) > 0 THEN list_append(s.out, x.i) ELSE s.out END}) AS z FROM g)
        SELECT word, first FROM n WHERE i NOT IN (SELECT unnest(z.out) FROM f)""",
    "person_parse": """SELECT c_custkey, lower(c_mktsegment) AS first, 'o' || lower(c_mktsegment) AS last, true AS same FROM customer""",
    "template_fill": """
        SELECT n_nationkey, n || ' (' || n_nationkey || ') of region ' || n_regionkey || '; ' || n AS text
        FROM (SELECT *, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS n FROM nation)""",
}
