"""Importance resampling of documents towards a target distribution.

A text's features are its runs of one to three words, hashed to buckets by their
CRC-32. The documents become a sparse matrix of documents by buckets, persisted
once as blocks of compressed sparse rows (CSR): the row ends, bucket numbers and
counts of some thousand documents each. Column sums of the blocks give the corpus
distribution, those of the target's blocks the target's; the log of their
smoothed ratio is a bucket's gain, and the product of the sparse matrix with the
gains is each document's weight. Texts are cut into words once.

A weight plus a Gumbel noise that follows from the document's id orders the
documents; the first ones by that order are a sample without replacement in
proportion to the exponentials of weights. Ranks come from the counts of higher
scores and a window over equal ones, so that no task orders all documents.

Null and empty texts have no features and weight 0. Texts of any length are cut
by pieces, so that a task holds one piece's words at a time. Rows with a null id
count in the distribution, have a null score and are never drawn. Repeated rows
are drawn each. Ties go to the smaller id, then to fewer features. Empty tables
give no rows; an empty target gives gains of smoothing alone. Of other columns of
the input none is read or returned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import WORD_TABLE, written
from ruleloom.operators.sampling import carried

BUCKETS, LONGEST_RUN = 10_000, 3
#: Entries of a block and bytes of a text that are cut at once, about.
ENTRIES, PIECE = 1 << 20, 1 << 20

BLOCK = "doc_ids array<bigint>, n_words array<bigint>, n_features array<bigint>, row_ends binary, buckets binary, counts binary"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text of lowered words and blanks, piece by piece; none is cut."""
    begun = 0
    while begun < len(text):
        end = text.find(b" ", begun + PIECE)
        end = len(text) if end < 0 else end
        yield text[begun:end].split()
        begun = end


def counted(text: bytes | None) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, buckets that occur, and their counts."""
    n_words, n_features, total = 0, 0, np.zeros(BUCKETS, np.int64)
    before: list[bytes] = []  # the last words of the piece before
    for words in _pieces((text or b"").translate(WORD_TABLE)):
        n_words += len(words)
        here = before + words
        following = [b" " + w for w in here]
        run = list(map(zlib.crc32, here))
        for size in range(1, LONGEST_RUN + 1):
            # of the runs that begin in the words before, those that end there are counted already
            new = run[max(0, len(before) - size + 1):]
            n_features += len(new)
            total += np.bincount(np.array(new, np.int64) % BUCKETS, minlength=BUCKETS)
            run = list(map(zlib.crc32, following[size:], run))  # a run's CRC goes on over one word more
        before = here[-(LONGEST_RUN - 1):]
    at = np.flatnonzero(total)
    return n_words, n_features, at.astype(np.uint16), total[at]


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts as pairs of 16 bits would waste most of them: one byte each, and eight
    bytes more for each count of 255 and over, in order."""
    return np.concatenate([np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype("<i8").view(np.uint8)])


def _wide(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    counts = raw[:n].astype(np.int64)
    counts[counts == 255] = raw[n:].view("<i8")
    return counts


def count_matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """BLOCK rows of the documents, written to the shared folder: as many as tasks
    and entries ask for, of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        entries = 0

        def block() -> pa.RecordBatch:
            ids, words, features, buckets, counts = zip(*rows)
            ends = np.cumsum([len(b) for b in buckets]).astype("<i8")
            data = (ends.tobytes(), np.concatenate(buckets).astype("<u2").tobytes(), _narrow(np.concatenate(counts)).tobytes())
            lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (ids, words, features)]
            return pa.record_batch([*lists, *(pa.array([d], pa.binary()) for d in data)], ["doc_ids", "n_words", "n_features", "row_ends", "buckets", "counts"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                rows.append((i.as_py(), *counted(t.as_py())))
                entries += len(rows[-1][3]) + 8
                if entries >= ENTRIES:
                    yield block()
                    rows, entries = [], 0
        if rows:
            yield block()

    return written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, BLOCK))


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ends, buckets and counts of a block."""
    ends, buckets = np.frombuffer(row["row_ends"], "<i8"), np.frombuffer(row["buckets"], "<u2")
    return ends, buckets, _wide(row["counts"], len(buckets))


def column_sums(blocks: DataFrame) -> np.ndarray:
    """The count of each bucket over all documents: BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, buckets, counts = _entries(row)
                total += np.bincount(buckets, counts, BUCKETS).astype(np.int64)  # of one block: exact
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = blocks.select("row_ends", "buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    out[[r["bucket"] for r in sums]] = [r["n"] for r in sums]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the corpus."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sparse matrix times the gains, block by block."""
    shared = blocks.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, buckets, counts = _entries(row)
                upto = np.append(0, np.cumsum(shared.value[buckets] * counts))
                weight = np.diff(upto[np.append(0, ends)])
                yield pa.record_batch([pa.array(row[c], pa.int64()) for c in ("doc_ids", "n_words", "n_features")] + [pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) that follows from seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, of: Column, percent: int) -> DataFrame:
    """``scored`` (doc_id, n_features, score, ...) with rank: 1, 2, 3 ... for the
    floor(percent * N / 100) highest scores of the N rows that ``of`` holds for, else null."""
    able = scored.where(of & F.col("score").isNotNull())
    most = able.count() * percent // 100
    counts = able.groupBy("score").agg(F.count("*").alias("n")).withColumn("down", -F.col("score"))
    higher = carried(counts, [], ["down"], F.floor(F.col("down") / 512), "sum", F.col("n"), "higher").where(F.coalesce("higher", F.lit(0)) < most)
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features"))
    marked = scored.withColumn("able", F.coalesce(of & F.col("score").isNotNull(), F.lit(False)))
    first = higher.select(F.col("score").alias("of_score"), F.coalesce("higher", F.lit(0)).alias("higher"))
    met = marked.join(first, F.col("able") & (F.col("score") == F.col("of_score")), "left").drop("of_score")
    top = met.where("higher is not null").withColumn("rank", F.col("higher") + place)
    rest = met.where("higher is null").withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("able", "higher")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document."""
    blocks = count_matrix(docs, doc_id, text)
    aims = count_matrix(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "id")
    gain = gains(column_sums(blocks), column_sums(aims))
    scored = written(weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return drawn(scored, F.col("n_words") >= least_words, percent)


def op13_importance_resampling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


#: Words of a text, by SQL's own means.
_SQL_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP13_SQL = f"""
    WITH bytes AS (  -- the CRC of each byte
      SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS crc),
    w AS (SELECT 0 AS kind, row_number() OVER () AS row, doc_id, {_SQL_WORDS} AS w FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, {_SQL_WORDS} FROM benchmark),
    g AS (
      SELECT kind, row, f, count(*) AS c FROM (
        SELECT kind, row, unnest(w) AS f FROM w
        UNION ALL SELECT kind, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
        UNION ALL SELECT kind, row, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w) GROUP BY ALL),
    h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM g)),
    b AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, y: xor(c // 256, crc[xor(c % 256, y) + 1]))) % {BUCKETS} AS bucket FROM h, bytes),
    m AS (SELECT kind, row, bucket, sum(c) AS c FROM g JOIN b USING (f) GROUP BY ALL),
    s AS (SELECT bucket, coalesce(sum(c) FILTER (WHERE kind = 0), 0) AS s, coalesce(sum(c) FILTER (WHERE kind = 1), 0) AS t FROM m GROUP BY 1),
    a AS (SELECT sum(s)::DOUBLE + {BUCKETS} AS s_all, sum(t)::DOUBLE + {BUCKETS} AS t_all FROM s),
    n AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * s_all / ((s::DOUBLE + 1) * t_all)))::BIGINT AS gain FROM s, a),
    d AS (SELECT row, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM m JOIN n USING (bucket) WHERE kind = 0 GROUP BY 1),
    r AS (
      SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN d USING (row) WHERE kind = 0),
    k AS (SELECT *, n_words >= 20 AND score IS NOT NULL AS able, row_number() OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id, n_features) AS place FROM r)
    SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT count(*) FROM k WHERE able) * 5 // 100 THEN place END AS rank FROM k"""
