"""Removal of byte strings that earlier documents have, by suffix arrays.

A byte goes if a string of LEAST bytes covers it that also starts in a document
with a smaller id. All is judged on the input.

1. Each window of LEAST bytes has a minimizer: the least hash among its
   strings of GRAM bytes. Equal windows have equal minimizers wherever they
   stand. Successive windows of one minimizer form a stretch.
2. Documents are dealt over packs of about PACK_BYTES, which stay what they are
   from here on. A pack sends each minimizer once, with the smallest and the
   largest document that has it, to the minimizer's bucket, and is told in a bit
   each whether two documents of the corpus have it.
3. Of the stretches of such minimizers a pack sends each text once, with the
   smallest document that has it, to the minimizer's shard. All equal windows
   meet in one shard. So what arrives for one minimizer or text grows with the
   number of packs that have it, not with that of documents or places.
4. A text that is the only one of its minimizer has no window in common with
   another. The others of a shard get a suffix array by induced sorting, and
   permuted common prefixes tell which neighbours agree for LEAST bytes. Runs of
   these are equal windows; each run has a smallest document.
5. A pack gets back, for the texts that it sent, the smallest document of each
   window, and rewrites its documents.

Packs, buckets and homes of shards are numbered by the bytes of the input, so
that each holds about as many whatever there is. Long texts are read in pieces of
CHUNK bytes. Each step is linear in the text.

Null texts count as empty. Rows with a null id take no part and lose nothing.
Repeated rows of an id are one document and lose the same bytes; rows of one
id with different texts are told apart, and none is smaller than another. Empty
tables give none; of other columns of the input none is returned, and none is
in the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import partitions
from ruleloom.llm.suffix import permuted_prefixes, suffix_array

LEAST, GRAM, KEY_BYTES = 50, 20, 5
#: Bytes of a piece of a text, bytes that are hashed at once, windows of a
#: stretch at most, bytes of text of a pack, of a bucket and of a home, and shards
#: of a home, which are sorted one after the other.
CHUNK, AT_ONCE, STRETCH, PACK_BYTES, BUCKET_BYTES, HOME_BYTES, SHARDS = 1 << 20, 1 << 17, 4_096, 12 << 20, 24 << 20, 24 << 20, 8

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


def minimizers(b: np.ndarray) -> np.ndarray:
    """The minimizer of every window of LEAST bytes."""
    def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        h = (left * _P) ^ (right + (right >> np.uint64(31)))
        return h ^ (h >> np.uint64(29))

    h = b.astype(np.uint64)
    for step in (1, 2, 4, 8):  # of 2, 4, 8 and 16 bytes
        h = pair(h[:-step], h[step:])
        if step == 2:
            four = h
    h = pair(h[:-4], four[16:])  # of GRAM bytes
    h *= _Q
    h ^= h >> np.uint64(32)
    need = LEAST - GRAM + 1  # grams of a window: 31
    for step in (1, 2, 4, 8):
        h = np.minimum(h[:-step], h[step:])
    return np.minimum(h[:-(need - 16)], h[need - 16:])


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all stretches of the texts, in order: the text's number, the place in it,
    the number of windows and the minimizer."""
    none = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    out, batch, size = [none], [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) - LEAST + 1, CHUNK):
            piece = t[at:at + CHUNK + LEAST - 1] if len(t) > CHUNK else t
            batch.append((k, at, piece))
            size += len(piece)
            if size >= AT_ONCE:
                out.append(_stretches(batch))
                batch, size = [], 0
    if batch:
        out.append(_stretches(batch))
    return tuple(np.concatenate(column) for column in zip(*out))


def _stretches(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of pieces of LEAST bytes or more, hashed together."""
    owner, at, texts = zip(*pieces)
    ends = np.cumsum([len(t) for t in texts])
    low = minimizers(np.frombuffer(b"".join(texts), np.uint8))
    inside = np.ones(len(low), bool)  # of windows that no end cuts
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    for e in ends[:-1].tolist():
        inside[e - LEAST + 1:e] = False
        new[e - LEAST + 1] = new[e] = True
    runs = np.flatnonzero(new)
    lengths = np.diff(np.append(runs, len(low)))
    kept = inside[runs]
    starts, lengths = runs[kept], lengths[kept]
    if lengths.max() > STRETCH:  # long repetitions
        parts = -(-lengths // STRETCH)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, lengths = np.repeat(starts, parts) + part * STRETCH, np.repeat(lengths, parts) - part * STRETCH
        lengths = np.minimum(lengths, STRETCH)
    piece = np.searchsorted(ends, starts, "right")
    begins = np.append(0, ends[:-1])
    return np.array(owner, np.int32)[piece], starts - (begins - np.array(at, np.int64))[piece], lengths.astype(np.int32), low[starts]


def _keys(low: np.ndarray) -> np.ndarray:
    """Minimizers are small numbers by choice, so they are mixed first."""
    h = low * _P
    return h ^ (h >> np.uint64(32))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _short(keys: np.ndarray) -> np.ndarray:
    """The lower KEY_BYTES of keys, as they travel. A bucket holds about a
    million keys; two that are equal by chance only add a candidate."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])


def _long(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = packed.reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def _squeeze(b: bytes) -> bytes:
    """What is shuffled is compressed better than by the shuffle itself."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b)


def _expand(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, mark, t): mark is a hash that tells texts of one id apart."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.select("id", F.xxhash64("t").alias("mark"), "t")


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_values):
        first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
        yield from zip(sorted_values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_values)])


class Pack:
    """The documents of a pack, by id and mark, and their stretches: document,
    place, number of windows and key of each, in order. Each key is numbered
    by bucket and, in a bucket, by where it comes first."""

    def __init__(self, rows: pd.DataFrame, buckets: int) -> None:
        self.docs = rows[["id", "mark", "t"]].drop_duplicates(["id", "mark"]).sort_values(["id", "mark"], ignore_index=True)
        self.ids = self.docs["id"].to_numpy(np.int64)
        self.raw = [t.encode("utf-8", "surrogatepass") for t in self.docs["t"]]
        self.owner, self.start, self.windows, low = stretches(self.raw)
        self.key = _keys(low)
        order = np.argsort(self.key, kind="stable")
        new = np.flatnonzero(np.append(True, self.key[order][1:] != self.key[order][:-1])) if len(order) else np.zeros(0, np.int64)
        first, last = order[new], order[np.append(new[1:], len(order))[:len(new)] - 1]
        bucket = _bucket(self.key[first], buckets)
        by = np.lexsort((first, bucket))
        self.first, self.last, self.bucket = first[by], last[by], bucket[by]
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.repeat(number, np.diff(np.append(new, len(order))))

    def shared(self, told: pd.DataFrame) -> np.ndarray:
        """Of each key, whether two documents have it: bits from all buckets put together."""
        sizes = np.bincount(self.bucket, minlength=1)
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(sizes[k])) for k, b in told.sort_values("at")[["at", "bits"]].itertuples(index=False)]
        return np.concatenate(bits) if bits else np.zeros(0, np.uint8)

    def sent(self, shared: np.ndarray, homes: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
        """For each shard, in order: its number, the distinct texts of the pack's
        stretches whose keys are shared, the stretches, and which text each has."""
        at = np.flatnonzero(shared[self.number])
        shard = _bucket(self.key[at], homes * SHARDS)
        order = np.argsort(shard, kind="stable")
        for k, a, z in _runs(shard[order]):
            which = at[order[a:z]]
            own: dict[bytes, int] = {}
            raw = self.raw
            number = np.fromiter((own.setdefault(raw[d][s:s + n + LEAST - 1], len(own)) for d, s, n in zip(self.owner[which].tolist(), self.start[which].tolist(), self.windows[which].tolist())), np.int64, len(which))
            yield k, list(own), which, number


def _minimizers_of(buckets: int):
    """A pack to (pack, bucket, ids, counts, lows, more, most): each of its
    minimizers once, with its smallest document; ``more`` are those that another
    document of the pack has too, ``most`` the largest one that has it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pack, out = Pack(pdf, buckets), []
        smallest, largest, low = pack.ids[pack.owner[pack.first]], pack.ids[pack.owner[pack.last]], pack.key[pack.first]
        for b, a, z in _runs(pack.bucket):
            ids, counts = np.unique(smallest[a:z], return_counts=True)
            more = np.flatnonzero(largest[a:z] > smallest[a:z])
            blobs = (ids.tobytes(), counts.astype(np.uint32).tobytes(), _short(low[a:z]).tobytes(), _squeeze(more.astype(np.uint32).tobytes()), _squeeze(largest[a:z][more].tobytes()))
            out.append((int(pdf["pack"].iloc[0]), b, *blobs))
        return pd.DataFrame(out, columns=["pack", "bucket", "ids", "counts", "lows", "more", "most"])

    return run


def _joined(blobs, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in blobs])


def _shared_minimizers(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket to (pack, at, bits): for each minimizer that a pack sent, in that
    order, whether two documents have it."""
    low = _long(_joined(pdf["lows"], np.uint8))
    smallest = np.repeat(_joined(pdf["ids"], np.int64), _joined(pdf["counts"], np.uint32))
    largest, sizes, at = smallest.copy(), [len(b) // KEY_BYTES for b in pdf["lows"]], 0
    for n, more, most in zip(sizes, pdf["more"], pdf["most"]):
        largest[at + np.frombuffer(_expand(more), np.uint32)] = np.frombuffer(_expand(most), np.int64)
        at += n
    order = np.argsort(low, kind="stable")
    low = low[order]
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    shared = np.empty(len(low), bool)
    shared[order] = np.repeat(np.minimum.reduceat(smallest[order], first) < np.maximum.reduceat(largest[order], first), np.diff(np.append(first, len(low))))
    ends = np.cumsum(sizes).tolist()
    return pd.DataFrame({"pack": pdf["pack"], "at": pdf["bucket"], "bits": [np.packbits(shared[a:z]).tobytes() for a, z in zip([0, *ends], ends)]})


def _stretches_of(buckets: int, homes: int):
    """A pack and what it was told to (pack, home, smallest, sizes, texts): what it
    sends to each of the home's SHARDS shards. One row more, of a negative home,
    goes back to the pack with the bits that it was told."""

    def run(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list] = {}
        if len(pdf):
            pack = Pack(pdf, buckets)
            shared = pack.shared(told)
            for shard, texts, which, number in pack.sent(shared, homes):
                first = which[np.unique(number, return_index=True)[1]]
                packed = _squeeze(pack.ids[pack.owner[first]].tobytes()), np.array([len(x) for x in texts], np.uint32).tobytes(), _squeeze(b"".join(texts))
                out.setdefault(shard // SHARDS, [None] * SHARDS)[shard % SHARDS] = packed
        number = int(pdf["pack"].iloc[0]) if len(pdf) else 0
        rows = [(number, h, *([p and p[k] for p in shards] for k in range(3))) for h, shards in out.items()]
        if rows:
            rows.append((number, -1 - number, [np.packbits(shared).tobytes()], None, None))
        return pd.DataFrame(rows, columns=["pack", "home", "smallest", "sizes", "texts"])

    return run


def equal_windows(texts: list[bytes], smallest: np.ndarray) -> np.ndarray:
    """For each byte of the texts laid end to end with a gap between: the
    smallest document of the window that starts there (the largest integer
    where none starts), found from the suffix array."""
    sizes = np.array([len(t) for t in texts])
    s = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 2
    gaps = np.cumsum(sizes + 1) - 1
    s[gaps] = 1
    s = np.append(s, np.uint16(0))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    window = np.zeros(len(s), bool)
    window[:-1] = np.repeat(gaps, sizes + 1) - np.arange(len(s) - 1) >= LEAST
    sa = suffix_array(s, 258)
    agrees = permuted_prefixes(s, sa) >= LEAST
    value = np.full(len(s), np.iinfo(np.int64).max)
    value[:-1][window[:-1]] = smallest[owner][window[:-1]]
    # suffixes of one run agree with their predecessors for LEAST bytes
    new = np.flatnonzero(~(agrees & window)[sa])
    least = np.minimum.reduceat(value[sa], new)
    out = np.empty(len(s), np.int64)
    out[sa] = np.repeat(least, np.diff(np.append(new, len(sa))))
    out[~window] = np.iinfo(np.int64).max
    return out


def shard_windows(texts: list[bytes], smallest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each distinct text, one after the other, the smallest
    document that has it; and where each text's windows begin. ``smallest`` is
    the smallest document that has the whole text."""
    windows = np.array([len(t) - LEAST + 1 for t in texts])
    ends = np.cumsum(windows)
    least = np.repeat(smallest, windows)
    # the minimizers of the texts' first windows
    heads = minimizers(np.frombuffer(b"".join(t[:LEAST] for t in texts), np.uint8))[::LEAST]
    _, kind, copies = np.unique(heads, return_inverse=True, return_counts=True)
    several = np.flatnonzero(copies[kind] > 1)
    if len(several):
        found = equal_windows([texts[k] for k in several], smallest[several])
        own = windows[several]
        offset = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        begins = np.cumsum(own + LEAST) - own - LEAST  # a text has LEAST - 1 bytes more than windows, and a gap
        least[np.repeat((ends - windows)[several], own) + offset] = found[np.repeat(begins, own) + offset]
    return least, ends - windows


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """A home's shards, one after the other, to (pack, at, runs, values): for the
    windows of the texts that a pack sent, in that order, the smallest documents
    as runs of equal ones."""
    if pdf["home"].iloc[0] < 0:
        return pd.DataFrame({"pack": pdf["pack"], "at": pdf["home"], "runs": pdf["smallest"], "values": None})
    out: list[list] = [[None] * SHARDS for _ in range(len(pdf))]
    for k in range(SHARDS):
        packed = [(r, s[k], n[k], t[k]) for r, (s, n, t) in enumerate(zip(pdf["smallest"], pdf["sizes"], pdf["texts"])) if t[k] is not None]
        if not packed:
            continue
        distinct: dict[bytes, int] = {}
        numbers, ids = [], []
        for _, smallest, sizes, text in packed:
            text, ends = _expand(text), np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
            numbers.append(np.fromiter((distinct.setdefault(text[a:z], len(distinct)) for a, z in zip([0, *ends], ends)), np.int64, len(ends)))
            ids.append(np.frombuffer(_expand(smallest), np.int64))
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, np.concatenate(numbers), np.concatenate(ids))
        texts = list(distinct)
        value, begins = shard_windows(texts, least)
        windows = np.array([len(t) - LEAST + 1 for t in texts])
        for (r, *_), number in zip(packed, numbers):
            n = windows[number]
            own = value[np.arange(n.sum()) + np.repeat(begins[number] - (np.cumsum(n) - n), n)]
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[r][k] = _squeeze(np.diff(np.append(new, len(own))).astype(np.uint32).tobytes()), _squeeze(own[new].tobytes())
    return pd.DataFrame({"pack": pdf["pack"], "at": pdf["home"], "runs": [[p and p[0] for p in row] for row in out], "values": [[p and p[1] for p in row] for row in out]})


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans; those that touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _result(doc_id: int | None, raw: bytes, spans: np.ndarray, with_text: bool) -> tuple:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2])) if len(spans) else raw
    return doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})


def _rewritten(buckets: int, homes: int, with_text: bool):
    """A pack and its answers to RESULT."""

    def run(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return _frame([])
        pack = Pack(pdf, buckets)
        answers = {int(h): row for h, *row in told[["at", "runs", "values"]].itertuples(index=False)}
        back = answers.get(-1 - int(pdf["pack"].iloc[0]))  # none where no key is shared
        shared = np.unpackbits(np.frombuffer(back[0][0], np.uint8), count=len(pack.first)) if back else np.zeros(len(pack.first), np.uint8)
        spans: dict[int, list[np.ndarray]] = {}
        for shard, texts, which, number in pack.sent(shared, homes):
            runs, values = (np.frombuffer(_expand(blob[shard % SHARDS]), kind) for blob, kind in zip(answers[shard // SHARDS], (np.uint32, np.int64)))
            least = np.repeat(values, runs)
            sizes = np.array([len(t) - LEAST + 1 for t in texts])
            begins, n = (np.cumsum(sizes) - sizes)[number], sizes[number]
            row = np.repeat(np.arange(len(which)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            owner = pack.owner[which]
            gone = least[begins[row] + offset] < pack.ids[owner][row]
            row, offset = row[gone], offset[gone]
            if len(row):
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)))
                last = np.append(new[1:], len(row)) - 1
                begin = pack.start[which]
                found = np.stack([begin[row[new]] + offset[new], begin[row[last]] + offset[last] + LEAST], 1)
                by = np.argsort(owner[row[new]], kind="stable")
                for d, a, z in _runs(owner[row[new]][by]):
                    spans.setdefault(d, []).append(found[by[a:z]])
        none = np.zeros((0, 2), np.int64)
        done = [_result(int(i), raw, merged(np.concatenate(spans[k])) if k in spans else none, with_text) for k, (i, raw) in enumerate(zip(pack.ids, pack.raw))]
        place = {key: k for k, key in enumerate(zip(pack.docs["id"], pack.docs["mark"]))}
        return _frame([done[place[key]] for key in zip(pdf["id"], pdf["mark"])])  # repeated rows too

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """RESULT for every row of ``docs``; kept holds the remaining bytes."""
    spark = docs.sparkSession
    rows = _texts(docs, doc_id, text)
    known, unknown = rows.where(F.col("id").isNotNull()), rows.where(F.col("id").isNull())
    total = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    packs, buckets, homes = (max(partitions(spark), -(-total // most)) for most in (PACK_BYTES, BUCKET_BYTES, HOME_BYTES))
    # all that is done with a pack reads this one exchange
    placed = known.withColumn("pack", F.pmod(F.xxhash64("id", "mark"), F.lit(packs)))
    packed = placed.groupBy("pack").applyInPandas(_minimizers_of(buckets), "pack long, bucket long, ids binary, counts binary, lows binary, more binary, most binary")
    told = packed.groupBy("bucket").applyInPandas(_shared_minimizers, "pack long, at long, bits binary")
    sent = placed.groupBy("pack").cogroup(told.groupBy("pack")).applyInPandas(_stretches_of(buckets, homes), "pack long, home long, smallest array<binary>, sizes array<binary>, texts array<binary>")
    answers = sent.groupBy("home").applyInPandas(_answers, "pack long, at long, runs array<binary>, values array<binary>")
    out = placed.groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(_rewritten(buckets, homes, with_text), RESULT)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _frame([_result(None, t.encode("utf-8", "surrogatepass"), np.zeros((0, 2), np.int64), with_text) for t in pdf["t"]])

    out = out.unionByName(unknown.select("t").mapInPandas(whole, RESULT))
    return out if with_text else out.drop("kept")


def op9_suffix_array_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False)
