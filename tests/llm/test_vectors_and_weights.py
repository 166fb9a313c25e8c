"""Whitening, nearest neighbours and resampling against brute force and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import ann, resampling, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "mine") for i, v in rows], "vec_id long, embedding array<double>, whitened string").repartition(3)


# 11
def plain_whitening(x, k):
    z = x - x.sum(0) / len(x)
    e, u = np.linalg.eigh(z.T @ z / len(x))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return z @ u / np.sqrt(e), e


def test_whitening_query_against_numpy(spark):
    out = whitening.op11_embedding_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(t["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    y, e = plain_whitening(x, 32)
    got = out["whitened"].to_numpy().reshape(len(x), 32)
    signs = np.sign((got * y).sum(0))
    assert np.abs(got - y * signs).max() < 1e-8
    n, s = len(x), x.sum(0)
    assert (out["deviation"].to_numpy() == np.repeat(((n * x - s) ** 2).sum(1), 32)).all() and (out["n"] == n).all()
    z = x - s / n
    assert np.allclose(out["explained"].to_numpy()[:32], e / (z * z).sum() * n, rtol=1e-9)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-10
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-10


@pytest.mark.parametrize("kind", ["close", "steep", "low rank"])
def test_subspace_of_wide_vectors_is_certified(spark, kind):
    """More dimensions than a basis holds: close eigenvalues, steep ones, and a table of low rank."""
    rng, d = np.random.default_rng(5), 420
    a = rng.standard_normal((900, d)) * (np.linspace(1, 0.9, d) if kind == "close" else 0.97 ** np.arange(d))
    if kind == "low rank":
        a = rng.standard_normal((900, 6)) @ rng.standard_normal((6, d))
        a = np.round(a)
    model = whitening.fit(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a * 50)], "vec_id long, embedding array<double>"), k=8)[d]
    x = np.floor(64 * a * 50) + 1_000_000
    z = x - x.mean(0)
    e = np.linalg.eigvalsh(z.T @ z / len(x))[::-1]
    k = 6 if kind == "low rank" else 8
    assert len(model.eigenvalues) >= k and np.allclose(model.eigenvalues[:k], e[:k], rtol=1e-11)
    for v, value in zip(model.components, model.eigenvalues):
        assert np.linalg.norm(z.T @ (z @ v) / len(x) - value * v) <= 1e-11 * e[0]
    assert model.identity_error < 1e-6


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(20)] + [(3, [0.5, 0.5, 0.5])] * 2 + [(None, [1.0, 2.0, 3.0])]
    other = [(100 + i, [float(i % 4), 1.0]) for i in range(8)]  # another length; its second dimension is constant
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [NAN, 1.0, 1.0]), (53, [INF, 1.0, 1.0]), (54, []), (55, [1.0])]
    df = vectors(spark, good + other + odd)
    model = whitening.fit(df)
    assert {d: len(m.eigenvalues) for d, m in model.items()} == {1: 0, 2: 1, 3: 3} and model[3].n == 23
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "whitened", "_whitened"]
    by = {r["vec_id"]: r for r in out.collect()}
    assert all(by[i]["_whitened"] is None for i in (50, 51, 52, 53)) and by[54]["_whitened"] == by[55]["_whitened"] == [] and by[1]["whitened"] == "mine"
    x = np.floor(64 * np.array([v for _, v in good]))
    y, _ = plain_whitening(x, 3)
    got = np.array([by[i]["_whitened"] for i in range(3)])
    assert np.abs(np.abs(got) - np.abs(y[:3])).max() < 1e-9
    assert whitening.fit(df.limit(0)) == {}
    with pytest.raises(Exception, match="too large"):
        whitening.fit(vectors(spark, [(1, [1e18, 0.0]), (2, [0.0, 1.0])]))


def test_centring_keeps_what_large_sums_would_lose(spark):
    """A mean of 2^40 with a spread of a few units."""
    rng = np.random.default_rng(2)
    a = 2.0**34 + rng.integers(-3, 4, (200, 4))
    model = whitening.fit(vectors(spark, list(enumerate(a.tolist()))))[4]
    z = 64 * (a - a.mean(0))
    assert np.allclose(model.eigenvalues, np.linalg.eigvalsh(z.T @ z / 200)[::-1], rtol=1e-12) and model.identity_error < 1e-12


def test_deviation_beyond_64_bits_is_told(spark):
    df = spark.createDataFrame([([1, 5],)], "x array<long>")
    ok = df.select(whitening.deviation(F.col("x"), F.lit(3), F.array(F.lit(6), F.lit(9))).alias("v")).first()["v"]
    assert ok == 9 + 36
    with pytest.raises(Exception, match="too large"):
        df.select(whitening.deviation(F.col("x"), F.lit(10**10), F.array(F.lit(1), F.lit(1)))).collect()


# 12
def brute_nearest(rows, asking, k):
    """Of each (id, vector) asked, (id, distance) of all other rows, nearest first."""
    out = {}
    for i, v in asking:
        each = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), j) for j, w in rows if j != i and len(w) == len(v))
        out[i] = [(j, s) for s, j in each[:k]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, due):
    met = sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in near}) for i, near in due.items())
    return met / max(1, sum(len(near) for near in due.values()))


def test_neighbours_of_the_query_against_brute_force(spark):
    got = by_query(ann.op12_ann_cross_polytope(spark, SF))
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    due = brute_nearest(rows, [(i, v) for i, v in rows if i % 100 == 0], 10)
    assert set(got) == set(due) and all(len(got[i]) == 10 for i in due) and recall(got, due) >= 0.9
    true = dict(rows)
    for i, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        for j, s in near:
            assert s == pytest.approx(math.dist(true[i], true[j]), rel=1e-14)


@pytest.mark.parametrize("parts", ["one task", "many parts"])
def test_neighbours_among_copies(spark, parts, monkeypatch):
    """A third of all rows equal, another third near copies, repeated rows, ids with two vectors."""
    if parts == "many parts":
        monkeypatch.setattr(ann, "ROWS", 12 * 20)
        monkeypatch.setattr(ann, "QUERIES", 12 * 4)
    rng = np.random.default_rng(4)
    base = np.round(rng.standard_normal((200, 12)), 3)
    near = np.round(base[1] + rng.normal(0, 0.01, (200, 12)), 4)
    all_ = np.concatenate([base, np.repeat(base[:1], 200, 0), near])
    ids = rng.permutation(len(all_)).tolist()
    rows = list(zip(ids, all_.tolist())) + [(ids[0], base[0].tolist())] * 15 + [(ids[5], base[6].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    asking = {i: min(v for j, v in rows if j == i) for i in ids if i % 7 == 0}
    got = by_query(ann.nearest(df, df.where("id % 7 = 0"), 10))
    due = brute_nearest(rows, asking.items(), 10)
    assert set(got) == set(due) and all(len(got[i]) == 10 for i in due) and recall(got, due) >= 0.9
    same = [i for i in asking if asking[i] == base[0].tolist()]
    assert same and all(got[i] == due[i] for i in same)  # ties of copies go to the smaller ids


def test_neighbours_of_odd_rows(spark):
    odd = [(1, None), (2, [0.0, 0.0]), (3, [NAN, 1.0]), (4, [1.0, None]), (5, [1.0, INF]), (None, [1.0, 1.0]), (6, [])]
    rows = [(100, [1.0, 0.0]), (101, [0.0, 1.0]), (102, [-1.0, 0.5]), (200, [3.0, 4.0]), (300, [1.0, 1.0, 1.0]), (301, [5.0, 1.0, 1.0]), (400, [9.0] * 5)]
    df = spark.createDataFrame(odd + rows, "vec_id long, embedding array<double>")
    usable = ann.usable(df, "vec_id", "embedding")
    got = by_query(ann.nearest(usable, usable.where("id % 100 = 0"), 10))
    due = brute_nearest(rows, [(i, v) for i, v in rows if i % 100 == 0], 10)
    assert got == {i: near for i, near in due.items() if near}  # all candidates where they are fewer; none alone in its length
    assert ann.nearest(usable.limit(0), usable.limit(0), 10).count() == 0


def test_pseudo_rotation_keeps_lengths_and_probes_begin_at_the_own_bucket():
    rng = np.random.default_rng(6)
    m = rng.standard_normal((50, 20))
    a = ann.rotated(m, 1, 0)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert a.shape == (50, 32) and np.allclose(a @ a.T, unit @ unit.T)
    for parts in (1, 2):
        own, order = ann.buckets(m, parts), ann.probes(m, parts, 64 if parts == 1 else 4096)
        assert (order[:, :, 0] == own).all() and all(len(set(order[i, t])) == order.shape[2] for i in range(50) for t in range(ann.TABLES))


def test_more_rows_ask_for_more_hashes(spark, monkeypatch):
    """Two hashes to a bucket: recall is measured and reached all the same."""
    monkeypatch.setattr(ann, "BUCKET", 4)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 16))
    rows = [(i, (centres[i % 60] + rng.normal(0, 0.25, 16)).tolist()) for i in range(1_500)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got, due = by_query(ann.nearest(df, df.where("id % 20 = 0"), 10)), brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert recall(got, due) >= 0.9


# 13
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), Counter(zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def plain_resampling(docs, target, percent):
    """Sorted (doc_id, n_features, weight, score, rank) by plain counting."""
    each = [(i, *features(t)) for i, t in docs]
    s, t = sum((c for _, _, c in each), Counter()), sum((features(x)[1] for x in target), Counter())
    s_all, t_all = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out, able = [], []
    for i, n, c in each:
        weight = sum(gain[b] * k for b, k in c.items())
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, c.total(), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20 and h is not None:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_query_against_plain_counting(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = resampling.op13_importance_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampling(docs, target, 5)


def test_resampling_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 64)
    monkeypatch.setattr(resampling, "ENTRIES", 500)
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 60, n))
    docs = [(i, text(int(rng.integers(15, 60)))) for i in range(60)] + [(70, None), (71, ""), (72, "..."), (73, "Ünïcode ΑΒΓ x1 " * 30), (74, "one " * 4_000), (75, "a" * 5_000), (None, text(30)), (None, None)]
    docs += [docs[3]] * 3 + [(3, text(25))]
    target = [text(40), None, "", text(5)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(4)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, aims, percent=30).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampling(docs, target, 30)
    assert resampling.resample(df.limit(0), aims).count() == 0
    none = resampling.resample(df.limit(5), aims.limit(0)).collect()
    assert len(none) == 5


def test_counts_of_a_text_do_not_depend_on_its_pieces(monkeypatch):
    text = ("alpha Beta  gamma-delta é9 " * 50).encode()
    whole = resampling.counted(text)
    for piece in (1, 7, 30, 100):
        monkeypatch.setattr(resampling, "PIECE", piece)
        part = resampling.counted(text)
        assert part[:2] == whole[:2] and (part[2] == whole[2]).all() and (part[3] == whole[3]).all()
    assert whole[:2] == (250, 747)
    big = np.array([1, 254, 255, 256, 70_000, 2])
    assert (resampling._wide(resampling._narrow(big).tobytes(), 6) == big).all()


def test_ties_of_scores_are_drawn_by_id(spark):
    rows = [(i, 5, 20, 7, 100 if i % 3 else 101) for i in range(300)]
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, n_words long, weight long, score long").repartition(6)
    got = {r["doc_id"]: r["rank"] for r in resampling.drawn(scored, F.col("n_words") >= 20, 50).collect()}
    due = sorted((-s, i) for i, _, _, _, s in rows)[:150]
    assert {i: k for i, k in got.items() if k} == {i: k + 1 for k, (_, i) in enumerate(due)}
