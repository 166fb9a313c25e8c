"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and of the long words' beginnings, hashed to
buckets. From labelled rows the buckets whose presence depends on the label
(by the G statistic) are kept, and a factorization machine is trained on them:
a weight for each term and a factor vector for each, whose inner products
weigh pairs of terms. So an insult beside a group mention can count for more
than both do alone.

Fitted on a bounded sample of labelled rows: TOXIC_ROWS and CLEAN_ROWS, those
of smallest hash of their id. The classes are weighted back to their true
shares, which are counted over all labelled rows. Training runs in one task,
whose input these bounds limit; scoring runs where the rows lie.

Null and empty texts get the score of a text without terms. Rows with null
labels or ids teach nothing; a label that is repeated weighs as often, and of
labels of one id that differ each does; any label over 0 is toxic. Of documents
with one id a single one teaches, that of the least buckets. Without training rows of both
classes the score is the share of toxic rows (0 where there are none). Extra
columns stay; output columns that clash with an existing name get a leading
underscore.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import crc_mod, fresh, words

TOXIC_ROWS, CLEAN_ROWS = 3_000, 6_000
#: Hash buckets, terms that enter the machine, least G of a term, length of
#: its factor vectors, passes over the sample.
BUCKETS, TERMS, LEAST_G, FACTORS, EPOCHS = 1 << 20, 3_000, 12.0, 4, 30
#: Letters of a beginning.
BEGINNING = 7
SCHEMA = "score double, predicted int"


def bucket(term: bytes) -> int:
    return zlib.crc32(term) & (BUCKETS - 1)


def terms_of(word: bytes) -> tuple[int, ...]:
    """The buckets of a word: its own, and its beginning's if it is longer."""
    return (bucket(word), bucket(b"^" + word[:BEGINNING])) if len(word) > BEGINNING else (bucket(word),)


def _buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([np.unique(np.fromiter((b for w in set(words(t)) for b in terms_of(w)), np.int32)).tobytes() for t in texts])


def _g_statistic(in_toxic: np.ndarray, in_clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """G of the two-by-two table of presence by label."""
    total, g = n_toxic + n_clean, np.zeros(len(in_toxic))
    for k, n in ((in_toxic, n_toxic), (n_toxic - in_toxic, n_toxic), (in_clean, n_clean), (n_clean - in_clean, n_clean)):
        present = in_toxic + in_clean if k is in_toxic or k is in_clean else total - in_toxic - in_clean
        expected = present * n / total
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(k > 0, 2 * k * np.log(k / expected), 0.0)
    return g


def _machine(idx: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of rows of padded term numbers, and their factor sums."""
    rows = v[idx]
    s = rows.sum(1)
    return w0 + w[idx].sum(1) + 0.5 * (s * s - (rows * rows).sum(1)).sum(1), s


def _batch(flat: np.ndarray, owner: np.ndarray, n: int, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_machine`` for n rows whose terms are laid end to end."""
    rows = v[flat]
    s = np.stack([np.bincount(owner, rows[:, f], n) for f in range(v.shape[1])], 1)
    return w0 + np.bincount(owner, w[flat], n) + 0.5 * ((s * s).sum(1) - np.bincount(owner, (rows * rows).sum(1), n)), s


def fit_machine(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> dict:
    """Selects terms and trains by AdaGrad on the weighted log loss."""
    flat = np.concatenate([r for r in rows]) if rows else np.zeros(0, np.int32)
    owner = np.repeat(y, [len(r) for r in rows])
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    prior = float((weight * y).sum() / max(weight.sum(), 1e-9)) if len(y) else 0.0
    if not n1 or not n0:
        return {"terms": np.zeros(0, np.int32), "w0": float(np.log((prior + 1e-6) / (1 - prior + 1e-6))), "w": np.zeros(1), "v": np.zeros((1, FACTORS))}
    c1, c0 = (np.bincount(flat[owner == k], minlength=BUCKETS).astype(float) for k in (1, 0))
    g = _g_statistic(c1, c0, n1, n0)
    toxic_side = c1 / n1 > c0 / n0  # what marks clean texts is mostly their length
    order = np.argsort(-np.where(toxic_side, g, 0.0), kind="stable")[:TERMS]
    terms = np.sort(order[g[order] >= LEAST_G]).astype(np.int32)
    m = len(terms)
    kept = [np.searchsorted(terms, r[np.isin(r, terms)]) for r in rows]
    sizes = np.array([len(r) for r in kept])
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(m + 1), rng.normal(0, 0.01, (m + 1, FACTORS)), float(np.log(prior / (1 - prior)))
    v[m] = 0
    gw, gv, g0 = np.full(m + 1, 1e-2), np.full((m + 1, FACTORS), 1e-2), 1e-2
    weight = weight / weight.mean()
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            own, owner = np.concatenate([kept[i] for i in at]), np.repeat(np.arange(len(at)), sizes[at])
            z, s = _batch(own, owner, len(at), w0, w, v)
            d = weight[at] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
            dw = np.bincount(own, d[owner], m + 1)
            pull = d[owner, None] * (s[owner] - v[own])
            dv = np.stack([np.bincount(own, pull[:, f], m + 1) for f in range(FACTORS)], 1)
            dw += 1e-5 * w
            dv += 1e-4 * v
            dw[m], dv[m] = 0, 0
            gw, gv, g0 = gw + dw * dw, gv + dv * dv, g0 + d.sum() ** 2
            w -= 0.3 * dw / np.sqrt(gw)
            v -= 0.05 * dv / np.sqrt(gv)
            w0 -= 0.1 * d.sum() / np.sqrt(g0)
    return {"terms": terms, "w0": w0, "w": w, "v": v}


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """(i, y, b, times), the sampled ids with their terms and how often their label stands, and how many
    labels of each class there are. At most TOXIC_ROWS and CLEAN_ROWS rows, however often an id is repeated."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("i"), (F.col(label) > 0).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    once = known.groupBy("i", "y").agg(F.count("*").alias("times"))
    pick = [once.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(n) for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    # at most TOXIC_ROWS + CLEAN_ROWS narrow rows are broadcast
    few = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(pick[0].unionByName(pick[1])), "i")
    # of an id's documents one teaches
    found = few.select("i", "y", "times", F.pandas_udf(_buckets, "binary")("t").alias("b")).groupBy("i", "y").agg(F.min(F.struct("b", "times")).alias("s"))
    return found.select("i", "y", "s.b", "s.times"), totals


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The machine for ``labels`` (doc_id, label) of ``docs`` (doc_id, text)."""
    sample, totals = training_rows(docs, labels, doc_id, text, label)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "y"], kind="stable")
        y, times = pdf["y"].to_numpy(), pdf["times"].to_numpy(float)
        share = {k: totals.get(k, 0) / max(1.0, times[y == k].sum()) for k in (0, 1)}
        model = fit_machine([np.frombuffer(b, np.int32) for b in pdf["b"]], y, times * np.where(y == 1, share[1], share[0]))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    found = sample.groupBy(F.lit(0).alias("all")).applyInPandas(train, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit_machine([], np.zeros(0), np.zeros(0))


def scorer(model: dict, spark):
    """A function of a text column that gives SCHEMA. The model holds at most TERMS terms."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        place = {int(b): k for k, b in enumerate(m["terms"])}
        w0, w, v = m["w0"], m["w"], m["v"]
        known: dict[bytes, tuple[int, ...]] = {}
        for texts in batches:
            logits = np.empty(len(texts))
            for i, t in enumerate(texts):
                hit: set[int] = set()
                for word in set(words(t)):
                    if (k := known.get(word)) is None:
                        if len(known) > 200_000:
                            known.clear()
                        k = known[word] = tuple(place[b] for b in terms_of(word) if b in place)
                    if k:
                        hit.update(k)
                logits[i] = _machine(np.array([sorted(hit)], int), w0, w, v)[0][0] if hit else w0
            score = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pd.DataFrame({"score": score, "predicted": (score >= 0.5).astype("int32")})

    return F.pandas_udf(run, SCHEMA)


def score_toxicity(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``df`` with score and predicted; the text alone is read for them."""
    (hit,) = fresh(df, "hit")
    out = df.withColumn(hit, scorer(model, df.sparkSession)(F.col(text)))
    return out.select(*df.columns, *(F.col(hit)[a].alias(b) for a, b in zip(("score", "predicted"), fresh(df, "score", "predicted"))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels teach nothing: crc32(doc_id as text) mod 5 is 0. A null id is held out."""
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(True))


def learned(spark, docs: DataFrame, sf_dir: str) -> dict:
    """The machine learned from the rows of the labels table that may teach."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return fit_toxicity(docs.select("doc_id", "text"), labels)


def op10_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learned(spark, docs, sf_dir)
    return score_toxicity(docs.withColumn("held_out", held_out(F.col("doc_id"))), model).drop("text")
