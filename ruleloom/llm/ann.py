"""Approximate nearest neighbours by cross-polytope hashing.

A vector of unit length, padded with zeros to a power of two, goes through a
pseudo-rotation: three rounds of random signs and a fast Hadamard transform. Its
hash is the axis, with a sign, that is nearest to what comes out. A table's bucket
is one such hash, or several where the rows ask for more buckets, and each of
TABLES tables rotates by signs of its own.

A query looks into more than its own bucket: those whose signed axes are next
nearest follow. How many is measured: for SAMPLE vectors the true neighbours are
found by brute force over all rows, and with them the place that a neighbour's
bucket has in the query's order, so the recall of any number of probes is known.
The least number that reaches RECALL is taken; it may be all buckets. All rows of
a probed bucket are candidates, and distances are worked out on the original
vectors; products only tell which of them can't be among the nearest.

Equal vectors are one candidate with the k + 1 smallest ids (no other can be among
k nearest, as ties go to the smaller id), so a group of copies is one row however
large. Buckets of many rows or queries are dealt over blocks, each of which gives
at most k rows for a query. Queries that find fewer than k rows look into all buckets.

Vectors that are null, zero or empty, or hold a null or non-finite component, take
no part; nor do rows with a null id. Vectors meet only those of equal length. A
query's own rows are those of its id; repeated rows of another id are candidates
each. A repeated query asks once; if one id has several vectors, the smallest asks.
Empty tables give no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import written

#: Tables, vectors of a bucket about (more ask for another hash), measured recall
#: that probes must reach, vectors it is measured with and their components at most.
TABLES, BUCKET, RECALL, SAMPLE, SAMPLE_COMPONENTS = 4, 4_096, 0.96, 256, 4_000_000
#: Components of a bucket's vectors and of its queries that meet in one task at most.
ROWS, QUERIES = 1 << 20, 1 << 18

FOUND = "query_id long, vec_id long, score double, copies int, of_vector long"


# hashing

def hadamard(a: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row."""
    n, d = a.shape
    h = 1
    while h < d:
        a = a.reshape(n, d // (2 * h), 2, h)
        a = np.concatenate([a[:, :, :1] + a[:, :, 1:], a[:, :, :1] - a[:, :, 1:]], 2)
        h *= 2
    return a.reshape(n, d) / np.sqrt(d)


def rotated(vectors: np.ndarray, table: int, part: int) -> np.ndarray:
    """Unit vectors after the pseudo-rotation of a table's part."""
    most = np.abs(vectors).max(1, keepdims=True)
    unit = vectors / np.where(most > 0, most, 1)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    size = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    a = np.zeros((len(unit), size))
    a[:, : vectors.shape[1]] = unit
    rng = np.random.default_rng([table, part, size])
    for _ in range(3):
        a = hadamard(a * rng.choice([-1.0, 1.0], size))
    return a


def buckets(vectors: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    out = np.zeros((len(vectors), TABLES), np.int64)
    for t in range(TABLES):
        for p in range(parts):
            a = rotated(vectors, t, p)
            axis = np.abs(a).argmax(1)
            out[:, t] = out[:, t] * (2 * a.shape[1]) + 2 * axis + (a[np.arange(len(a)), axis] < 0)
    return out


def probes(vectors: np.ndarray, parts: int, most: int) -> np.ndarray:
    """The first ``most`` buckets of each vector in each table, nearest first: by the
    sum over parts of the squared distance to the nearest axis's coordinate."""
    n = len(vectors)
    every = []
    for t in range(TABLES):
        key, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for p in range(parts):
            a = rotated(vectors, t, p)
            signed = np.stack([a, -a], 2).reshape(n, -1)
            order = np.argsort(-signed, 1, kind="stable")[:, :most]
            near = np.take_along_axis(signed, order, 1)
            total = (cost[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(n, -1)
            codes = (key[:, :, None] * signed.shape[1] + order[:, None, :]).reshape(n, -1)
            best = np.argsort(total, 1, kind="stable")[:, :most]
            key, cost = np.take_along_axis(codes, best, 1), np.take_along_axis(total, best, 1)
        every.append(key)
    return np.stack(every, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, _matrix(column.take(pa.array(at)))


def _hashed(width: str, f):
    """A function of a column of vectors that gives lists of 64-bit numbers, by ``f`` of vectors of one length."""

    def run(column: pa.Array) -> pa.Array:
        out: list = [None] * len(column)
        for at, m in _by_length(column):
            for i, row in zip(at, f(m)):
                out[i] = row.ravel()
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(run, width)


# distances

def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of both, pair by pair."""
    return np.sqrt(((queries - vectors) ** 2).sum(1))


def nearest_of(queries: np.ndarray, vectors: np.ndarray, k: int, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of all vectors that are no farther than a query's
    k-th nearest. Products bound what is worked out exactly."""
    with np.errstate(over="ignore", invalid="ignore"):
        q2, v2 = (queries * queries).sum(1), (vectors * vectors).sum(1)
        near = q2[:, None] + v2[None, :] - 2 * (queries @ vectors.T)
        if barred is not None:
            near[barred] = np.inf
        bound = np.partition(near, k - 1, 1)[:, k - 1] if near.shape[1] > k else np.full(len(queries), np.inf)
        possible = ~(near > (bound + 1e-9 * (q2 + v2.max(initial=0)))[:, None])
    if barred is not None:
        possible &= ~barred
    q, v = np.nonzero(possible)
    score = np.concatenate([distances(queries[q[i:i + 100_000]], vectors[v[i:i + 100_000]]) for i in range(0, len(q), 100_000)]) if len(q) else np.zeros(0)
    return q, v, score


# the search

def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))) & F.exists(embedding, lambda x: x.cast("double") != 0)
    kept = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & fine)
    v = F.col(embedding) if dict(vectors.dtypes)[embedding] == "array<float>" else F.col(embedding).cast("array<double>")
    return kept.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids, copies): each different vector once, with its k + 1 smallest ids and
    how many rows each has (k at most: no more can be among the nearest)."""
    counts = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    first = counts.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rn") <= k + 1)
    each = first.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("all"))
    return each.select("v", F.col("all.id").alias("ids"), F.col("all.n").alias("copies"))


def tune(vectors: DataFrame, asking: DataFrame, others: DataFrame, parts: dict[int, int], k: int) -> dict[int, int]:
    """Probes for each length of vectors: the fewest that reach RECALL on SAMPLE
    vectors, those that ask first, against all rows by brute force."""
    widest = max(parts)
    size = max(1, min(SAMPLE, SAMPLE_COMPONENTS // (k * widest)))
    picked = asking.select("v", F.lit(0).alias("kind")).unionByName(others.select("v", F.lit(1).alias("kind")))
    sample: dict[int, list] = {}
    for d in parts:  # SAMPLE vectors of each length
        mine = picked.where(F.size("v") == d).orderBy("kind", F.xxhash64("v"), "v").limit(size)
        sample[d] = np.array([r["v"] for r in mine.select("v").collect()], np.float64).reshape(-1, d)
    shared = vectors.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for _, m in _by_length(batch.column(0)):
                d = m.shape[1]
                q, v, score = nearest_of(shared.value[d], m, k + 1)
                others = score > 0
                q, v, score = q[others], v[others], score[others]
                found = (q, score, buckets(m[v], parts[d]))
                old = best.get(d)
                q, score, codes = found if old is None else tuple(np.concatenate(x) for x in zip(old, found))
                order = np.lexsort((score, q))
                q, score, codes = q[order], score[order], codes[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                best[d] = (q[kept], score[kept], codes[kept])
        for d, (q, score, codes) in best.items():
            yield pa.record_batch([pa.array(np.full(len(q), d, np.int32)), pa.array(q.astype(np.int32)), pa.array(score), pa.array(list(codes), pa.list_(pa.int64()))], ["d", "q", "score", "codes"])

    near = vectors.select("v").mapInArrow(run, "d int, q int, score double, codes array<bigint>")
    rank = F.row_number().over(Window.partitionBy("d", "q").orderBy("score", "codes"))
    truth = near.withColumn("rn", rank).where(F.col("rn") <= k).select("d", "q", "codes").collect()  # SAMPLE * k rows of each length
    shared.unpersist()
    out = {}
    for d, parts_of in parts.items():
        q = np.array([r["q"] for r in truth if r["d"] == d], np.int64)
        codes = np.array([r["codes"] for r in truth if r["d"] == d], np.int64).reshape(-1, TABLES)
        every = (2 << max(0, int(d - 1).bit_length())) ** parts_of
        most = min(every, 256)
        while True:
            order = probes(sample[d], parts_of, most)
            place = np.full(len(q), every)
            for i in range(len(q)):
                hit = np.argwhere(order[q[i]] == codes[i][:, None])
                if len(hit):
                    place[i] = hit[:, 1].min()
            need = int(np.ceil(RECALL * len(q)))
            last = int(np.sort(place)[need - 1]) + 1 if len(q) else every
            if last <= most or most == every:
                out[d] = min(last, every)
                break
            most = min(every, most * 8)
    return out


def _dealt(df: DataFrame, most: int, out: str) -> DataFrame:
    """``df`` with ``out``: rows of a (d, t, bucket) that has over ``most`` components are dealt over parts."""
    large = df.groupBy("d", "t", "bucket").agg(F.ceil(F.count("*") * F.greatest("d", F.lit(1)) / most).cast("int").alias(f"{out}s")).where(F.col(f"{out}s") > 1)
    met = df.join(large, ["d", "t", "bucket"], "left")
    return met.withColumn(f"{out}s", F.coalesce(f"{out}s", F.lit(1))).withColumn(out, F.pmod(F.xxhash64("v", "key"), F.col(f"{out}s")).cast("int"))


def search(index: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """FOUND for each query and bucket: ``index`` (d, t, bucket, v, number, ids, copies) and
    ``asking`` (d, t, bucket, query_id, v)."""
    rows = _dealt(index.withColumn("key", F.lit(0).cast("long")), ROWS, "rpart")
    asks = _dealt(asking.withColumnRenamed("query_id", "key"), QUERIES, "qpart")
    place = ["d", "t", "bucket"]
    # a part of the rows meets each part of the queries
    sizes = lambda df, part: df.groupBy(*place).agg(F.max(f"{part}s").alias(f"of_{part}")).where(F.col(f"of_{part}") > 1)
    spread = lambda df, part: df.withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(f"of_{part}", F.lit(1)) - 1)))
    left = spread(rows.join(sizes(asks, "qpart"), place, "left"), "qpart").select(*place, "rpart", "qpart", "v", "number", "ids", "copies")
    right = spread(asks.join(sizes(rows, "rpart"), place, "left"), "rpart").select(*place, "rpart", "qpart", F.col("key").alias("query_id"), "v")
    key = [*place, "rpart", "qpart"]

    def run(own: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.float64, np.int32, np.int64)]
        if own.num_rows and asks.num_rows:
            vectors, queries, asked = _matrix(own["v"]), _matrix(asks["v"]), asks["query_id"].to_numpy()
            ids, copies = (own[c].combine_chunks() for c in ("ids", "copies"))
            sizes = np.diff(ids.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            ids, copies = ids.flatten().to_numpy(), copies.flatten().to_numpy()
            number = own["number"].to_numpy()
            step = max(1, 4_000_000 // len(vectors))
            for i in range(0, len(queries), step):
                # of vectors with one id, a query's own take no part; else the id is left out below
                barred = (sizes == 1)[None, :] & (ids[starts][None, :] == asked[i:i + step, None])
                q, v, score = nearest_of(queries[i:i + step], vectors, k, barred)
                n = sizes[v]
                pair = np.repeat(np.arange(len(q)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[v], n)
                q, score, vec, many, number_of = asked[i:i + step][q[pair]], score[pair], ids[at], copies[at], number[v[pair]]
                kept = vec != q
                q, score, vec, many, number_of = (x[kept] for x in (q, score, vec, many, number_of))
                order = np.lexsort((vec, score, q))
                order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
                for o, x in zip(out, (q, vec, score, many, number_of)):
                    o.append(x[order])
        return pa.table([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score", "copies", "of_vector"])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, FOUND)


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of what all buckets gave, copies one by one."""
    once = found.groupBy("query_id", "vec_id", "score", "of_vector").agg(F.max("copies").alias("copies"))
    each = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of (id, v) queries among (id, v) rows."""
    lengths = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not lengths:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    # as many hashes in a bucket as leave some BUCKET vectors in it
    parts = {d: max(1, round(float(np.log(max(n, 2) / BUCKET) / np.log(2 << max(0, int(d - 1).bit_length()))))) for d, n in lengths.items()}
    of_rows = _hashed("array<bigint>", lambda m: buckets(m, parts[m.shape[1]]))
    index = written(candidates(rows, k).withColumn("b", of_rows("v")).withColumn("number", F.xxhash64("v")))
    asking = queries.groupBy("id").agg(F.min("v").alias("v")).select(F.col("id").alias("query_id"), "v")
    probed = tune(index, asking, index, parts, k)
    of_queries = _hashed("array<bigint>", lambda m: probes(m, parts[m.shape[1]], probed[m.shape[1]]))
    asking = written(asking.withColumn("d", F.size("v")).withColumn("b", of_queries("v")))
    posted = index.select(F.size("v").alias("d"), F.posexplode("b").alias("t", "bucket"), "v", "number", "ids", "copies")
    looked = asking.select("d", "query_id", "v", F.posexplode("b").alias("at", "bucket"), (F.size("b") / TABLES).cast("int").alias("each"))
    found = written(merged(search(posted, looked.select("d", F.expr("at div each").cast("int").alias("t"), "bucket", "query_id", "v"), k), k))
    short = asking.join(found.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti").select("d", "query_id", "v")
    if short.isEmpty():
        return found
    one = posted.where("t = 0")
    every = one.select(*(F.col(c).alias(c) for c in ("d", "t", "bucket"))).distinct()
    rest = merged(search(one, short.join(every, "d"), k), k)
    return found.join(short.select("query_id"), "query_id", "left_anti").select(*found.columns).unionByName(rest)


def op12_ann_cross_polytope(spark, sf_dir):
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding")
    return nearest(rows, rows.where(F.col("id") % 100 == 0), 10)
