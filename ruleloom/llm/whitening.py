"""Whitening of embeddings by block subspace iteration, without a covariance matrix.

Each component c of a vector becomes the integer x = floor(64 * c) + 1000000. A
first pass counts the vectors and sums each dimension exactly. After that a pass
over the table multiplies centred rows by a block of directions and back,
X'(XQ) / n, and sums what each task has found; no pass holds more than a
dimension by block matrix, and no table is written between passes.

On the driver the block joins those before it; QR keeps the basis orthonormal
and Rayleigh-Ritz takes the best directions of the whole span. Powers of the
block alone would gain e_(b+1) / e_k a pass, which is 0.99 for embeddings; the
span of all blocks needs few passes. Their residuals give the next block. When
the residuals of all k components are under TOLERANCE, one more pass multiplies
the components themselves: its residuals certify them, and its products give the
whitened vectors' covariance. Otherwise the iteration goes on from there.

Rows are centred before they are multiplied: x less the whole part of the mean is
an exact integer, and only then is the fraction taken away. Vectors of different
lengths have models of their own, all worked out in the same passes.

Vectors that are null, or hold a null or non-finite component, take no part; empty
ones have no component. Repeated rows count as often as they stand. Rows with a
null id count too. Directions whose variance is at most FLOOR of the largest (as
where vectors are equal, or fewer than the components) can't be told from
rounding and are no components. Components of 2^46 and more, or sums beyond 64
bits, are an error. Empty tables give no model and no rows. Extra columns stay; a
column that clashes gets a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import fresh

#: Components, directions of a block beyond them, blocks of a basis before it is
#: cut back to its best two blocks, residual over the largest eigenvalue that
#: certifies a component, least variance over the largest, passes at most.
COMPONENTS, BEYOND, BLOCKS, TOLERANCE, FLOOR, PASSES = 32, 16, 8, 1e-13, 1e-10, 200
#: The residual that the certifying pass may find: it is rounded anew.
CERTIFIED = 1e-12

SHIFT = 1_000_000


@dataclass
class Whitening:
    """The model of the vectors of one length. ``components`` has a row for each."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))


def takes_part(embedding: Column) -> Column:
    return embedding.isNotNull() & F.forall(embedding, _finite)


def integers(embedding: Column) -> Column:
    """The integer components of a vector. Spark may work this out before a filter
    that stands above it, so entries of vectors that take no part give null, no error."""
    return F.transform(embedding, lambda c: F.when(F.abs(c.cast("double")) < 2.0**46, F.floor(c.cast("double") * 64) + SHIFT)
                       .when(_finite(c), F.raise_error(F.lit("a component is too large for whitening")).cast("long")))


def _matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The vectors of a batch whose only column is lists of integers, by length."""
    lists = batch.column(0)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        if d:
            yield flat.reshape(-1, d) if (sizes == d).all() else flat[starts[sizes == d, None] + np.arange(d)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([(s % n) / n for s in sums])


def _totals(rows: DataFrame) -> dict[int, tuple[int, list[int], float]]:
    """Of each length: vectors, exact sums of the dimensions."""
    each = rows.select(F.size("x").alias("d"), F.posexplode("x").alias("at", "x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.groupBy("d", "at").agg(F.count("*").alias("n"), F.try_sum("x").alias("s")).orderBy("d", "at").collect():
        if r["s"] is None:
            raise OverflowError("the sum of a dimension is too large for 64 bits")
        out.setdefault(r["d"], (r["n"], []))[1].append(r["s"])
    return out


def _product(rows: DataFrame, totals: dict, blocks: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """One pass: X'(XQ) / n on the centred rows for the block of each length, and the
    total variance. What travels is a block of numbers a task, summed by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast((totals, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, blocks = shared.value
        found: dict[int, list] = {}
        for batch in batches:
            for x in _matrices(batch):
                d = x.shape[1]
                if d not in blocks:
                    continue
                n, sums = totals[d]
                for part in np.array_split(x, -(-len(x) * d // 2_000_000)):
                    z = _centred(part, n, sums)
                    mine = found.setdefault(d, [np.zeros_like(blocks[d]), 0.0])
                    mine[0] += z.T @ (z @ blocks[d]) / n
                    mine[1] += float((z * z).sum()) / n
        for d, (p, trace) in found.items():
            i, j = np.indices(p.shape).reshape(2, -1)
            flat = [np.append(i, -1), np.append(j, -1), np.append(p.ravel(), trace)]
            yield pa.record_batch([pa.array(np.full(len(flat[0]), d, np.int32)), *(pa.array(a, t) for a, t in zip(flat, (pa.int32(), pa.int32(), pa.float64())))], ["d", "i", "j", "v"])

    parts = rows.select("x").mapInArrow(run, "d int, i int, j int, v double")
    out = {d: [np.zeros_like(q), 0.0] for d, q in blocks.items()}
    # d x block numbers for each length, whatever the rows
    for r in parts.groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        if r["i"] < 0:
            out[r["d"]][1] = r["v"]
        else:
            out[r["d"]][0][r["i"], r["j"]] = r["v"]
    shared.unpersist()
    return {d: (p, trace) for d, (p, trace) in out.items()}


class Iteration:
    """The subspace of one length: an orthonormal basis, its products, the next block."""

    def __init__(self, d: int, k: int, seed: int = 11) -> None:
        self.d, self.k, self.width = d, min(k, d), min(d, k + BEYOND)
        self.basis, self.images = np.zeros((d, 0)), np.zeros((d, 0))
        self.block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, self.width)))[0]
        self.certifying, self.passes, self.done = False, 0, False
        self.trace, self.identity_error = 0.0, 0.0
        self.vectors, self.values = np.zeros((d, 0)), np.zeros(0)

    def _fresh(self, block: np.ndarray) -> np.ndarray:
        """An orthonormal basis of what a block adds to the subspace."""
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(3):
            block = block - self.basis @ (self.basis.T @ block)
            size = np.linalg.norm(block, axis=0)
            block = block[:, size > 1e-10] / size[size > 1e-10]
            q, r = np.linalg.qr(block)
            block = q[:, np.abs(np.diag(r)) > 1e-10][:, : self.d - self.basis.shape[1]]
        return block

    def step(self, product: np.ndarray, trace: float) -> None:
        """Takes a pass's product of ``block``; sets the next block or ends."""
        self.passes, self.trace = self.passes + 1, trace
        if self.certifying and self._certified(product):
            return
        self.basis, self.images = np.hstack([self.basis, self.block]), np.hstack([self.images, product])
        h = self.basis.T @ self.images
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        vectors, images = self.basis @ u, self.images @ u
        rest = images - vectors * values
        top = max(float(values[0]), np.finfo(float).tiny)
        sizes = np.linalg.norm(rest, axis=0) / top
        kept = int((values[: self.k] > FLOOR * top).sum()) if trace > 0 else 0
        self.vectors, self.values = vectors[:, :kept], values[:kept]
        if not kept:
            self.done = True
            return
        whole = self.basis.shape[1] == self.d
        if whole or (sizes[: self.k] <= TOLERANCE).all() or self.passes >= PASSES:
            self.certifying, self.block = True, np.linalg.qr(self.vectors)[0] * np.sign(np.diag(np.linalg.qr(self.vectors)[1]))
            self.basis, self.images = np.zeros((self.d, 0)), np.zeros((self.d, 0))
            return
        if self.basis.shape[1] > BLOCKS * self.width:
            self.basis, self.images = vectors[:, : 2 * self.width], images[:, : 2 * self.width]
        order = np.argsort(-sizes[: self.width], kind="stable")
        self.block = self._fresh(rest[:, : self.width][:, order])
        if not self.block.shape[1]:  # residuals of rounding alone: any other direction may help
            self.block = self._fresh(np.random.default_rng(self.passes).standard_normal((self.d, self.width)))

    def _certified(self, product: np.ndarray) -> bool:
        values = np.einsum("ij,ij->j", self.block, product)
        rest = np.linalg.norm(product - self.block * values, axis=0) / values.max()
        if (rest > CERTIFIED).any() and self.passes < PASSES:
            self.certifying = False
            return False
        if (rest > CERTIFIED).any():
            raise ArithmeticError(f"residual {rest.max():.1e} after {self.passes} passes")
        order = np.argsort(-values, kind="stable")
        self.vectors, self.values = self.block[:, order], values[order]
        covariance = self.vectors.T @ product[:, order] / np.sqrt(np.outer(self.values, self.values))
        self.identity_error, self.done = float(np.abs(covariance - np.eye(len(order))).max()), True
        return True


def fit(vectors: DataFrame, embedding: str = "embedding", k: int = COMPONENTS) -> dict[int, Whitening]:
    """The model of each length of vectors in the table."""
    rows = vectors.where(takes_part(F.col(embedding))).select(integers(F.col(embedding)).alias("x"))
    totals = _totals(rows)
    running = {d: Iteration(d, k) for d in totals}
    while blocks := {d: it.block for d, it in running.items() if not it.done}:
        for d, (product, trace) in _product(rows, totals, blocks).items():
            running[d].step(product, trace)
    return {d: Whitening(*totals[d], it.vectors.T, it.values, it.trace, it.identity_error, it.passes) for d, it in running.items()}


def whitened(model: dict[int, Whitening], spark):
    """A function of a column of integer vectors: each one's whitened components."""
    shared = spark.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        model = shared.value
        out: list = [None] * len(column)
        sizes = np.diff(column.offsets.to_numpy())
        missing = column.is_null().to_numpy(zero_copy_only=False)
        flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.where(missing, 0, sizes)) - np.where(missing, 0, sizes)
        for d in np.unique(sizes[~missing]):
            at = np.flatnonzero((sizes == d) & ~missing)
            if d not in model:
                y = np.zeros((len(at), 0))
            else:
                m = model[d]
                y = _centred(flat[starts[at, None] + np.arange(d)], m.n, m.sums) @ m.components.T / np.sqrt(m.eigenvalues)
            for i, row in zip(at, y):
                out[i] = row
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def whiten(vectors: DataFrame, model: dict[int, Whitening], embedding: str = "embedding") -> DataFrame:
    """``vectors`` with whitened: the components of each vector that takes part, else null."""
    (out,) = fresh(vectors, "whitened")
    x = F.when(takes_part(F.col(embedding)), integers(F.col(embedding)))
    return vectors.withColumn(out, whitened(model, vectors.sparkSession)(x))


def deviation(x: Column, n: Column, sums: Column) -> Column:
    """The exact sum over dimensions of (n * x - S)^2; beyond 64 bits it is an error."""
    parts = F.zip_with(x, sums, lambda a, s: a * n - s)
    near = F.aggregate(parts, F.lit(0.0), lambda t, p: t + p.cast("double") * p.cast("double"))
    return F.when(near < 9e18, F.aggregate(parts, F.lit(0).cast("long"), lambda t, p: t + p * p)).otherwise(F.raise_error(F.lit("a deviation is too large for 64 bits")).cast("long"))


def op11_embedding_whitening(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors)
    facts = spark.createDataFrame([(d, m.n, m.sums, m.explained, m.identity_error) for d, m in model.items()], "d int, n long, sums array<long>, explained array<double>, identity_error double")
    rows = whiten(vectors, model).where("whitened is not null").withColumn("x", integers(F.col("embedding")))
    met = rows.join(F.broadcast(facts), F.size("x") == F.col("d"))  # a row for each length of vectors
    once = met.withColumn("deviation", deviation(F.col("x"), F.col("n"), F.col("sums")))  # before a row becomes one for each component
    each = once.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
