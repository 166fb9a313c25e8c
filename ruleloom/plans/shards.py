"""Queries whose answers depend on the order of all rows before: budgets and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.operators import budgets as B
from ruleloom.operators import shards as S
from ruleloom.operators.sampling import shuffle_key
from ruleloom.sources.tables import table

CAP, SEED, MOST = 20_000_000, "plan-7", 500
TARGETS = S.Targets(pilot=4, load=6, broad=300, siblings=90, holdout=200, holdout_strata=("s1", "s4"))


def budget_admission(spark, sf_dir):
    """Orders as attempts, admitted under a cap for each priority: how many, which, and every spend."""
    price = F.floor("o_totalprice")
    attempts = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("budget"), F.col("o_orderkey").alias("attempt_id"), (price + 1_000).alias("reserved_nano"),
                                                     F.when(F.col("o_orderkey") % 4 != 0, price + F.col("o_custkey") % 700).alias("cost_nano"))
    done = B.admitted(attempts, CAP)
    return done.groupBy("budget").agg(F.count_if("admitted").alias("admitted"), F.max("spent_nano").alias("spent_nano"), F.sum(F.when(F.col("admitted"), F.col("attempt_id"))).alias("ids"),
                                      F.sum(F.col("spent_nano") % 100_003).alias("spends"), F.count("*").alias("n"))


def shard_families_in_order(spark, sf_dir):
    """Customers' orders as families, packed whole in one shuffled order."""
    fam = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return S.packed(fam, "o_custkey", "n", 95, shuffle_key(SEED, F.col("o_custkey")))


def bank(spark, sf_dir):
    """Line items (one of each order and number) as a bank of cases: every fourth order is a family of siblings of its
    first line, all others are cases by themselves."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").alias("l_quantity"))
    k, case, sibling = F.col("l_orderkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), (F.col("l_orderkey") % 4 == 0) & (F.col("l_linenumber") > 1)
    return li.select(case.alias("case_id"), F.element_at(F.array(*map(F.lit, ("chart", "inbox", "results"))), (k % 3 + 1).cast("int")).alias("workflow"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("stratum"),
                     F.when(k % 4 == 0, k * 10).otherwise(case).alias("family"), F.when(sibling, k * 10 + 1).alias("base"), F.when(k % 5 == 0, "holdout").otherwise("dev").alias("split"),
                     (F.col("l_quantity") % 11 == 0).alias("ambiguous"), (~sibling & (k % 5 != 0) & (case % 97 == 0)).alias("repeated"))


def shard_plan(spark, sf_dir):
    """Every case's place: the core shard with its phases, and the shards that hold the rest."""
    return S.plan(bank(spark, sf_dir), TARGETS, MOST, SEED)


QUERIES = {f.__name__: f for f in (budget_admission, shard_families_in_order, shard_plan)}


def _key(seed, x):
    return f"sha256('{seed}|' || ({x})::VARCHAR)"


def _turns(rows, n, seed, group=None):
    """Case ids by turns over strata, n for each group."""
    part = f"PARTITION BY {group} " if group else ""
    both = f"{group}, stratum" if group else "stratum"
    return f"""(SELECT case_id FROM (SELECT *, row_number() OVER (PARTITION BY {both} ORDER BY {_key(seed, 'case_id')}, case_id) AS rn FROM {rows})
          QUALIFY row_number() OVER ({part}ORDER BY rn, {_key(seed, 'stratum')}, stratum) <= {n})"""


def _packed(units, most):
    """The shard of each unit of ``units`` (unit, n, key): shard by shard, the next one begins
    with the first unit that doesn't fit. One pass over the units' sums for each shard."""
    return f"""
        o AS (SELECT unit, n, row_number() OVER (ORDER BY key, unit) AS pos, sum(n) OVER (ORDER BY key, unit)::BIGINT AS upto FROM {units}),
        b AS (SELECT 0::BIGINT AS shard, 1::BIGINT AS pos, 0::BIGINT AS before
          UNION ALL SELECT b.shard + 1, x.pos, x.upto - x.n FROM b, LATERAL (SELECT min(o.pos) AS p FROM o WHERE o.upto > b.before + {most} AND o.pos > b.pos) y JOIN o x ON x.pos = y.p),
        s AS (SELECT o.unit, o.n, b.shard FROM o ASOF JOIN b ON o.pos >= b.pos)"""


def _plan_sql():
    t = TARGETS
    load = " ".join(f"UNION ALL SELECT case_id, 0::BIGINT, '{p}', {rep} FROM {_turns('plain', t.load, f'{SEED}-{p}', 'workflow')}" for p, rep in t.load_reps.items())
    only = ", ".join(f"'{s}'" for s in t.holdout_strata)
    return f"""
        WITH RECURSIVE li AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_orderkey * 10 + l_linenumber AS case_id, 's' || (min(l_suppkey) % 7) AS stratum, min(l_quantity) % 11 = 0 AS ambiguous FROM lineitem GROUP BY 1, 2),
        c AS (SELECT case_id, ['chart', 'inbox', 'results'][k % 3 + 1] AS workflow, stratum, CASE WHEN k % 4 = 0 THEN k * 10 ELSE case_id END AS family, CASE WHEN k % 4 = 0 AND ln > 1 THEN k * 10 + 1 END AS base,
          k % 5 = 0 AS held, ambiguous, NOT (k % 4 = 0 AND ln > 1) AND k % 5 <> 0 AND case_id % 97 = 0 AS repeated FROM li),
        sib AS (SELECT * FROM c WHERE NOT held AND base IS NOT NULL), plain AS (SELECT * FROM c WHERE NOT held AND NOT ambiguous),
        alone AS (SELECT * FROM plain WHERE base IS NULL AND NOT repeated AND family NOT IN (SELECT family FROM sib)),
        pilot AS {_turns('alone', t.pilot, f'{SEED}-pilot', 'workflow')}, rep AS (SELECT case_id FROM c WHERE repeated),
        pool AS (SELECT case_id, stratum FROM c WHERE NOT held AND base IS NULL AND NOT repeated AND case_id NOT IN (FROM pilot)),
        room AS (SELECT least(greatest(0, {t.broad} - (SELECT count(*) FROM rep)), (SELECT count(*) FROM pool)) AS k),
        q AS (SELECT stratum, size * k // total AS floor, size * k % total AS rest, k - sum(size * k // total) OVER () AS short FROM (SELECT stratum, count(*) AS size, (SELECT count(*) FROM pool) AS total, k FROM pool, room GROUP BY stratum, k)),
        quota AS (SELECT stratum, floor + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= short THEN 1 ELSE 0 END AS quota FROM q),
        broad AS (FROM rep UNION ALL SELECT case_id FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_key(f'{SEED}-broad', 'case_id')}, case_id) AS rn FROM pool) JOIN quota USING (stratum) WHERE rn <= quota),
        fam AS (SELECT family, count(*) AS n FROM sib GROUP BY 1 HAVING bool_or(base IN (FROM pilot) OR base IN (FROM broad))),
        cut AS (SELECT family FROM (SELECT family, coalesce(sum(n) OVER (ORDER BY {_key(f'{SEED}-cf', 'family')}, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fam) WHERE before < {t.siblings}),
        cf AS (SELECT case_id FROM sib WHERE family IN (FROM cut)),
        spec AS (SELECT * FROM c WHERE held AND stratum IN ({only})), oth AS (SELECT * FROM c WHERE held AND stratum NOT IN ({only})),
        hold AS (SELECT case_id FROM spec WHERE (SELECT count(*) FROM spec) <= {t.holdout}
          UNION ALL FROM {_turns('oth', f"least({t.holdout}, (SELECT count(*) FROM c WHERE held)) - (SELECT count(*) FROM spec)", f'{SEED}-holdout')} WHERE (SELECT count(*) FROM spec) <= {t.holdout}
          UNION ALL FROM {_turns('spec', t.holdout, f'{SEED}-holdout')} WHERE (SELECT count(*) FROM spec) > {t.holdout}),
        gone AS (FROM pilot UNION ALL FROM broad UNION ALL FROM cf UNION ALL FROM hold),
        w AS (SELECT case_id, CASE WHEN held THEN 'case-' || case_id ELSE 'family-' || family END AS unit, CASE WHEN held THEN 'holdout' WHEN base IS NOT NULL THEN 'counterfactual' ELSE 'broad' END AS phase FROM c WHERE case_id NOT IN (FROM gone)),
        u AS (SELECT unit, n, {_key(f'{SEED}-pack', 'unit')} AS key FROM (SELECT unit, count(*)::BIGINT AS n FROM w GROUP BY 1)),{_packed('u', MOST)}
        SELECT case_id, 0::BIGINT AS shard, 'pilot' AS phase, 0::INTEGER AS rep FROM pilot UNION ALL SELECT case_id, 0, 'broad', 0 FROM broad UNION ALL SELECT case_id, 0, 'counterfactual', 0 FROM cf UNION ALL SELECT case_id, 0, 'holdout', 0 FROM hold
        UNION ALL SELECT case_id, 0, 'repeat', unnest(range(1, {t.repeats + 1}))::INTEGER FROM rep {load}
        UNION ALL SELECT case_id, s.shard + 1, phase, 0 FROM w JOIN s USING (unit)"""


ORACLE_SQL = {
    # a fold over each budget's attempts in order
    "budget_admission": f"""
        WITH a AS (SELECT o_orderpriority AS budget, o_orderkey AS id, floor(o_totalprice)::BIGINT AS p, o_custkey FROM orders),
        x AS (SELECT budget, list({{'id': id, 'r': p + 1000, 'c': CASE WHEN id % 4 <> 0 THEN p + o_custkey % 700 ELSE p + 1000 END, 'spent': 0::BIGINT, 'n': 0::BIGINT, 'ids': 0::BIGINT, 'spends': 0::BIGINT}} ORDER BY id) AS xs, count(*)::BIGINT AS n FROM a GROUP BY 1),
        f AS (SELECT budget, n, list_reduce(list_prepend({{'id': 0::BIGINT, 'r': 0::BIGINT, 'c': 0::BIGINT, 'spent': 0::BIGINT, 'n': 0::BIGINT, 'ids': 0::BIGINT, 'spends': 0::BIGINT}}, xs), lambda s, y: CASE WHEN s.spent + y.r <= {CAP}
          THEN {{'id': y.id, 'r': y.r, 'c': y.c, 'spent': s.spent + y.c, 'n': s.n + 1, 'ids': s.ids + y.id, 'spends': s.spends + (s.spent + y.c) % 100003}}
          ELSE {{'id': y.id, 'r': y.r, 'c': y.c, 'spent': s.spent, 'n': s.n, 'ids': s.ids, 'spends': s.spends + s.spent % 100003}} END) AS z FROM x)
        SELECT budget, z.n AS admitted, z.spent AS spent_nano, z.ids AS ids, z.spends AS spends, n FROM f""",
    "shard_families_in_order": f"""
        WITH RECURSIVE u AS (SELECT o_custkey AS unit, count(*)::BIGINT AS n, {_key(SEED, 'o_custkey')} AS key FROM orders GROUP BY 1),{_packed('u', 95)}
        SELECT unit AS o_custkey, n AS size, shard FROM s""",
    "shard_plan": _plan_sql(),
}
