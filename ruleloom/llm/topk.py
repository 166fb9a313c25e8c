"""Exact top-k by inner product over an impact-ordered index.

Components become integers, floor(64 * x). Vectors are dealt over blocks. In a
block's index each component is a posting (dimension, vector, quantised
impact); postings of equal absolute impact form a segment, and segments are
stored by descending impact. The part of each vector that segments so far do
not cover has a known length, and so the Cauchy-Schwarz inequality bounds what
they still can add to a score.

A query's k best of a bounded sample give a threshold that its true k best
reach. A search then goes through a block's segments score at a time, for many
queries at once, and stops only on proof: when few vectors are left whose upper
bound reaches the threshold, or when segments are at an end. Bounds are worth
comparing only where enough of the vectors is covered, which a few of the
queries tell. Vectors that may belong to the top k are then scored exactly from
their integers, so results are exact: recall is 1.

Query blocks travel to index blocks, and an index block once for each GROUP of
them; each gives at most k rows for a query, which a window merges.

Vectors that are null, or hold a null or non-finite component, take no part;
nor do rows with a null id. Components that make integers or scores of 64 bits
and more are an error. Vectors meet only those of equal length. A query's own
rows are those of its id; repeated rows of another id are candidates each.
Repeated rows of a query ask once; if one id has several vectors, the smallest
asks. Ties go to the smaller id. Empty tables give no rows; of other columns of
the input none is read or returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import checkpoint

#: Vectors of an index block and queries of a query block at most, least number
#: of blocks, query blocks that travel together, levels of impact, and the share
#: of a block that may be left to exact scoring when a search stops early.
BLOCK, QUERIES, LEAST_BLOCKS, GROUP, LEVELS, LEFT = 8_192, 1_024, 16, 64, 10, 0.05
#: Vectors and components of the sample that thresholds come from, at most, and
#: the part of all vectors that it may be.
SAMPLE, SAMPLE_COMPONENTS, SAMPLE_PART = 65_536, 4_000_000, 8

INDEX = "block long, dim int, ids binary, exact binary, ends array<long>, dims binary, vectors binary, values binary"


def integers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, dim, v): v are the integer components of vectors that take part."""
    scaled = lambda x: F.floor(x.cast("double") * 64)
    fits = lambda x: F.when(F.abs(x.cast("double")) < 2.0**57, scaled(x)).otherwise(F.raise_error(F.lit("a component is too large for 64 bits")).cast("long"))
    fine = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0) & fine)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.size(embedding).alias("dim"), F.transform(embedding, fits).alias("v"))


def _dealt(rows: DataFrame, most: int, name: str) -> DataFrame:
    n = rows.count()
    blocks = max(LEAST_BLOCKS, -(-n // most))
    # of a block, the vectors of one length; repeated rows of one id are dealt by their place
    return rows.withColumn(name, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))


def _matrix(v) -> np.ndarray:
    return np.array(v.tolist(), np.int64).reshape(len(v), -1)


def _index_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable")
    m = _matrix(pdf["v"])
    step = max(1, int(np.abs(m).max()) // (LEVELS - 1))
    level = np.abs(m) // step
    vectors, dims = np.nonzero(level)  # the lowest level has no impact; exact scoring covers it
    impact = level[vectors, dims]
    order = np.lexsort((vectors, dims, -impact))
    ends = np.append(np.unique(-impact[order], return_index=True)[1][1:], len(order)) if len(order) else np.zeros(0, np.int64)
    values = (np.sign(m[vectors, dims]) * (impact * step + (step - 1) / 2)).astype(np.float64)
    return pd.DataFrame({
        "block": [pdf["block"].iloc[0]], "dim": [m.shape[1]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "exact": [m.tobytes()], "ends": [ends.tolist()],
        "dims": [dims[order].astype(np.uint32).tobytes()], "vectors": [vectors[order].astype(np.uint16).tobytes()], "values": [values[order].tobytes()],
    })


def build_index(rows: DataFrame) -> DataFrame:
    """INDEX of (id, dim, v): one row for each block and vector length."""
    return _dealt(rows, BLOCK, "block").groupBy("block", "dim").applyInPandas(_index_block, INDEX)


def draw_sample(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by length, those of smallest hash: what the driver reads and
    sends to all has a bound."""
    most = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    size = min(SAMPLE, -(-most["n"] // SAMPLE_PART), SAMPLE_COMPONENTS // (most["dim"] or 1))
    found = rows.orderBy(F.xxhash64("id", "v"), "id").limit(size).toPandas()
    return {int(d): (part["id"].to_numpy(np.int64), _matrix(part["v"])) for d, part in found.groupby("dim")}


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of both, pair by pair."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound < 2.0**62:
        return np.einsum("ij,ij->i", queries, vectors)
    out = [sum(a * b for a, b in zip(q, v)) for q, v in zip(queries.tolist(), vectors.tolist())]
    if any(abs(x) >= 1 << 63 for x in out):
        raise OverflowError("a score is too large for 64 bits")
    return np.array(out, np.int64)


def thresholds(ids: np.ndarray, queries: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """For each query the k-th best score of the sample's other vectors, less what
    floating point may add to it; minus infinity where there are no k."""
    out = np.full(len(ids), -np.inf)
    if sample is None or len(sample[0]) <= k:
        return out
    own, q, v = ids[:, None] == sample[0][None, :], queries.astype(np.float64), sample[1].astype(np.float64)
    scores = np.where(own, -np.inf, q @ v.T)
    best = np.partition(scores, len(sample[0]) - k, axis=1)[:, len(sample[0]) - k]
    return best - np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max() * 1e-9


class Block:
    """An index block, with what its segments cover at the places where bounds may be compared."""

    def __init__(self, row) -> None:
        d = int(row.dim)
        self.ids, self.exact = np.frombuffer(row.ids, np.int64), np.frombuffer(row.exact, np.int64).reshape(-1, d)
        dims, vectors, values = np.frombuffer(row.dims, np.uint32), np.frombuffer(row.vectors, np.uint16), np.frombuffer(row.values, np.float64)
        self.length = np.linalg.norm(self.exact.astype(np.float64), axis=1)
        covered, begun = np.zeros((len(self.ids), d)), 0
        self.stages: list[tuple[np.ndarray, np.ndarray]] = []  # what segments up to a place add, and the lengths they leave
        added = np.zeros_like(covered)
        left = 0.5
        ends = list(row.ends)
        for end in ends or [0]:
            added[vectors[begun:end], dims[begun:end]] = values[begun:end]
            begun = end
            rest = np.linalg.norm(self.exact - covered - added, axis=1)
            if end == (ends or [0])[-1] or np.median(rest) <= left * np.median(self.length):
                self.stages.append((added.copy(), rest))
                covered += added
                added[:] = 0
                while left > 0 and np.median(rest) <= left * np.median(self.length):
                    left /= 2

    def possible(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Of each query and vector, whether the score may reach ``least``: segment by
        segment, until few are left."""
        own = ids[:, None] == self.ids[None, :]
        small = float(np.abs(self.exact).max(initial=0)) * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 1 << 22
        kind = np.float32 if small else np.float64
        q = queries.astype(kind)
        length = np.linalg.norm(queries.astype(np.float64), axis=1)
        noise = self.length * (1e-5 if small else 1e-12)
        scores, waiting = np.zeros(own.shape, kind), np.zeros(self.exact.shape)
        for k, (added, rest) in enumerate(self.stages):
            waiting = waiting + added
            slack = (rest + noise + 1e-3).astype(kind)
            last = k == len(self.stages) - 1
            if not last:  # are bounds worth comparing here? a few queries tell
                few = slice(0, None, max(1, len(q) // 32))
                told = scores[few] + q[few] @ waiting.T.astype(kind) + length[few, None].astype(kind) * slack >= least[few, None]
                if told.mean() > LEFT:
                    continue
            scores += q @ waiting.T.astype(kind)
            waiting = np.zeros(self.exact.shape)
            found = (scores + length[:, None].astype(kind) * slack >= (least - np.abs(least) * 1e-6)[:, None].astype(kind)) & ~own
            if last or found.mean() <= LEFT:
                return found
        return ~own

    def search(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, vector ids, scores) of the k best that reach ``least``, for a few queries at a time."""
        row, at = np.nonzero(self.possible(ids, queries, least))
        for part in np.array_split(np.arange(len(ids)), max(1, len(row) // 200_000)):
            if not len(part):
                continue
            a, z = np.searchsorted(row, [part[0], part[-1] + 1])
            r, v = row[a:z], at[a:z]
            score = products(queries[r], self.exact[v])
            order = np.lexsort((self.ids[v], -score, r))
            r, v, score = r[order], v[order], score[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r) < k
            yield ids[r[kept]], self.ids[v[kept]], score[kept]


def top_k(index: DataFrame, queries: DataFrame, k: int, sample: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for (id, dim, v) queries."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(sample or {})
    alone = queries.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.dim", "q.v")

    def query_block(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, q = pdf["id"].to_numpy(np.int64), _matrix(pdf["v"])
        least = thresholds(ids, q, shared.value.get(int(pdf["dim"].iloc[0])), k)
        return pd.DataFrame({"qblock": [pdf["qblock"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "query_ids": [ids.tobytes()], "queries": [q.tobytes()], "least": [least.tobytes()]})

    asked = checkpoint(_dealt(alone, QUERIES, "qblock").groupBy("qblock", "dim").applyInPandas(query_block, "qblock long, dim int, query_ids binary, queries binary, least binary"))
    asked = asked.withColumn("qgroup", F.expr(f"qblock div {GROUP}"))
    groups, blocks = asked.select("dim", "qgroup").distinct(), index.select("dim", "block").distinct()
    key = ["block", "qgroup", "dim"]
    left = index.join(groups, "dim").select(*key, "ids", "exact", "ends", "dims", "vectors", "values")
    right = asked.join(blocks, "dim").select(*(F.col(c).alias(f"of_{c}") for c in key), "query_ids", "queries", "least")

    def run(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        for row in own.itertuples(index=False):
            block = Block(row)
            for x in asking.itertuples(index=False):
                q = np.frombuffer(x.queries, np.int64).reshape(-1, row.dim)
                out += block.search(np.frombuffer(x.query_ids, np.int64), q, np.frombuffer(x.least, np.float64), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    found = left.groupBy(*key).cogroup(right.groupBy(*(f"of_{c}" for c in key))).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def is_query(vec_id: Column, every: int) -> Column:
    return vec_id % every == 0


def op5_exact_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = integers(vectors, "vec_id", "embedding")
    index = checkpoint(build_index(rows))
    return top_k(index, rows.where(is_query(F.col("id"), 20)), 20, draw_sample(rows))


OP5_SQL = """
    WITH e AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM s QUALIFY rank <= 20"""
