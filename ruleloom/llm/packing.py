"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids (byte-level BPE, then the end id). Only documents
longer than a sequence are cut: from their end into full pieces, so that the
first piece may be shorter. Full pieces fill a sequence each. All others are
dealt over blocks, each of which a grouping genetic algorithm evolves. The
well-filled bins then stand, but for some with small pieces; what a block packs
poorly can still be packed better together with these and with that of other
blocks. Such pieces are dealt over blocks of their own and evolved once more:

* an individual is a list of bins; it is better if it has fewer bins, and of
  as many bins if their squared fills sum to more;
* crossover injects whole well-filled bins of one parent into the other;
  bins of the other that hold an injected piece are dissolved, and pieces so
  displaced are put back by best fit, largest first;
* mutation dissolves some of the emptiest bins and puts their pieces back;
* each block is evolved on several islands; an island keeps its population,
  and after each epoch its elite goes to the next island of its block. At the
  lower bound (the pieces' tokens over the capacity) a block is done.

Null and empty texts are one piece that holds the end id alone. Repeated rows
are packed each for itself. Empty tables give no sequences. A document's row
is recognised by id and by place among rows of equal id.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import checkpoint, partitions

CAPACITY, END = 1_024, 2
END_BYTES = END.to_bytes(4, "little")
TOKENIZER = "byte_bpe_50k.json"
#: Words whose ids a Python worker keeps, in each of two halves, and bytes of texts that it parts at once.
WORDS, AT_ONCE = 250_000, 1 << 20
#: Pieces of a block, islands of a block, individuals of an island, epochs,
#: children of an epoch, and the share of an individual's bins that a
#: crossover injects.
BLOCK, ISLANDS, POPULATION, EPOCHS, CHILDREN, INJECT = 2_000, 2, 4, 3, 8, 0.3
#: Bins below this share are dissolved and evolved once more, over all blocks.
WELL_FILLED = 0.995


# Kinds of bytes in texts that PLAIN takes: spaces, letters, digits, others.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[9, 10, 13, 32]] = _SPACE
_KINDS[48:58] = _DIGIT
_KINDS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = _LETTER
#: Of Latin-1 and Latin Extended-A the characters of which it is plain what they are.
PLAIN = re.compile(r"[\t\n\r -^`-~¡-©«-±´¶-¸»¿-ſ]*\Z")
_WEIGHTS = np.random.default_rng(20240503).integers(1, 1 << 63, (2, 1 << 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_starts(b: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where words begin in the bytes of PLAIN texts that begin at ``docs``: as the
    tokenizer's own first step parts them. A word is a run of letters, digits
    or other characters, with one space before it if there is one, or a run of
    spaces without its last one if a word follows; 's, 't, 're, 've, 'm, 'll
    and 'd are words where a word would begin with them."""
    kind = _KINDS[b]
    tail = np.flatnonzero((b & 0xC0) == 0x80)
    kind[tail] = kind[tail - 1]
    signs = np.flatnonzero((b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7)))  # times and division
    kind[signs] = kind[signs + 1] = _OTHER
    begins = np.empty(len(b), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    text = np.zeros(len(b) + 1, bool)
    text[docs] = text[-1] = True
    begins |= text[:-1]
    run = np.flatnonzero(begins)
    follows = run[(kind[run] != _SPACE) & ~text[run]]
    follows = follows[kind[follows - 1] == _SPACE]  # words after spaces
    begins[follows - 1] = True
    begins[follows[b[follows - 1] == 0x20]] = False
    quote = run[(b[run] == 0x27) & begins[run]]
    for end in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        at = quote[quote + len(end) < len(b)]
        for k, c in enumerate(end, 1):
            at = at[(b[at + k] == c) & ~text[at + k]]
        begins[at + 1] = False
        after = at + 1 + len(end)
        begins[after[after < len(b)]] = True
    return np.flatnonzero(begins)


def _hashed(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
    """A hash of each word: the sum of its bytes, each times a weight of its place."""
    place = np.arange(len(b), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    return np.add.reduceat(_WEIGHTS[which][place] * (b + np.uint64(1)), starts)


class Tokens:
    """Texts to ids. The tokenizer's own first step parts a text into words, each
    of which it encodes for itself; so ids of words can be kept, here by two
    hashes. Texts that PLAIN doesn't take are encoded whole.

    When WORDS are kept they become the older half, from which words that come
    again move back; the half before is let go."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        told = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.characters = {b: c for k in range(0x800) for b, c in zip(chr(k).encode(), told(chr(k))[0][0])}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word_ids(self, word: bytes) -> bytes:
        """Of one word: the tokenizer's model alone, which reads a character for each byte."""
        return array("I", [token.id for token in self.model.tokenize(word.decode("latin-1").translate(self.characters))]).tobytes()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids and the end id, four bytes each."""
        plain: list[bytes | None] = []
        waiting: list[str | None] = []
        size = 0
        for t in texts:
            raw = t.encode() if t and len(t) <= 4 * AT_ONCE and PLAIN.match(t) and "<|" not in t else None
            plain.append(raw)
            waiting.append(t)
            size += len(raw or b"")
            if size > AT_ONCE or len(plain) > 4_096:
                yield from self._encoded(waiting, plain)
                plain, waiting, size = [], [], 0
        yield from self._encoded(waiting, plain)

    def _encoded(self, texts: list[str | None], plain: list[bytes | None]) -> Iterator[bytes]:
        packed = self._encode_plain([p for p in plain if p])
        for t, p in zip(texts, plain):
            yield (next(packed) if p else self._ids(t) if t else b"") + END_BYTES

    def _encode_plain(self, texts: list[bytes]) -> Iterator[bytes]:
        if not texts:
            return
        raw = b"".join(texts)
        b = np.frombuffer(raw, np.uint8)
        docs = np.cumsum([0, *map(len, texts)])
        starts = word_starts(b, docs[:-1])
        sizes = np.diff(np.append(starts, len(b)))
        if sizes.max() >= _WEIGHTS.shape[1]:  # one word of that many bytes
            yield from (self._ids(t.decode()) for t in texts)
            return
        one = _hashed(b, starts, sizes, 0)
        one ^= one >> np.uint64(32)
        order = np.argsort(one)
        same = one[order][1:] == one[order][:-1]
        if (same & (sizes[order][1:] != sizes[order][:-1])).any():  # two words of one hash
            yield from (self._ids(t.decode()) for t in texts)
            return
        first = order[np.flatnonzero(np.append(True, ~same))]
        number = np.empty(len(one), np.int32)
        number[order] = np.cumsum(np.append(False, ~same))
        words = [raw[s:z] for s, z in zip(starts[first].tolist(), (starts + sizes)[first].tolist())]
        lengths = sizes[first]
        two = _hashed(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths, 1)
        hashes = np.stack([one[first], two], 1).tobytes()
        keys = [hashes[k:k + 16] for k in range(0, len(hashes), 16)]
        ids = list(map(self.known.get, keys))
        new = []
        for k in [k for k, x in enumerate(ids) if x is None]:
            found = self.older.pop(keys[k], None)
            if found is None:
                new.append(k)
            else:
                ids[k] = self.known[keys[k]] = found
        for k in new:
            ids[k] = self.known[keys[k]] = self._word_ids(words[k])
        if len(self.known) > WORDS:
            self.known, self.older = {}, self.known
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat, begins = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths
        n = lengths[number]
        ends = np.cumsum(n)
        out = flat[np.arange(ends[-1]) + np.repeat(begins[number] - (ends - n), n)]
        edges = np.append(0, ends)[np.searchsorted(starts, docs)].tolist()
        yield from (out[a:z].tobytes() for a, z in zip(edges, edges[1:]))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


@cache
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]): the pieces of every
    document. ``row`` tells rows of equal id apart."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _tokens(tokenizer)
        for pdf in batches:
            out = []
            for i, r, ids in zip(pdf["i"], pdf["r"], tokens.encode_all(pdf["t"])):
                n = len(ids) // 4
                first = n % capacity or capacity if n > capacity else n
                for p, a in enumerate([0, *range(first, n, capacity)]):
                    b = min(n, first + p * capacity)
                    part = ids[4 * a:4 * b]
                    out.append((i, r, p, a, b - a, zlib.crc32(part)) + ((part,) if keep_ids else ()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.monotonically_increasing_id().alias("r"), F.col(text).alias("t"))
    return rows.mapInPandas(run, schema)


class Bins:
    """Open bins by room left, for best fit in logarithmic time."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int) -> None:
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.room = [capacity - z for z in fills(bins, sizes)]
        self.open = sorted([(r << 32) + k for k, r in enumerate(self.room) if r > 0])  # room, then number

    def put(self, items: list[int]) -> None:
        """Largest first, each into the fullest bin that takes it."""
        free, bins, room, capacity = self.open, self.bins, self.room, self.capacity
        for minus, i in sorted([(-self.sizes[i], i) for i in items]):
            s = -minus
            at = bisect_left(free, s << 32)
            if at < len(free):
                r, k = divmod(free.pop(at), 1 << 32)
                bins[k].append(i)
            else:
                r, k = capacity, len(bins)
                bins.append([i])
                room.append(r)
            room[k] = r - s
            if r > s:
                insort(free, ((r - s) << 32) + k)


def fills(bins: list[list[int]], sizes: list[int]) -> list[int]:
    """The tokens of each bin."""
    size = sizes.__getitem__
    return [sum(map(size, b)) for b in bins]


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, int]:
    """Larger is better."""
    return -len(bins), sum([z * z for z in fills(bins, sizes)])


def crossover(giver: list[list[int]], taker: list[list[int]], sizes: list[int], capacity: int, rng) -> list[list[int]]:
    """Some of the giver's best bins, whole; the taker's bins that share no
    piece with them; the rest by best fit."""
    fill = fills(giver, sizes)
    order = sorted(range(len(giver)), key=lambda k: (-fill[k], k))
    well = order[:max(1, int(len(order) * 2 * INJECT))]
    injected = [giver[k] for k in rng.permutation(well)[:max(1, len(well) // 2)]]
    inside = {i for b in injected for i in b}
    kept, displaced = [list(b) for b in injected], []
    for b in taker:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    child = Bins(kept, sizes, capacity)
    child.put(displaced)
    return child.bins


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng) -> list[list[int]]:
    """Dissolves the emptiest bins and a few others."""
    order = np.argsort(fills(bins, sizes), kind="stable").tolist()
    gone = set(order[:max(1, len(order) // 50)]) | set(rng.choice(len(bins), max(1, len(bins) // 50)).tolist())
    child = Bins([list(b) for k, b in enumerate(bins) if k not in gone], sizes, capacity)
    child.put([i for k in gone for i in bins[k]])
    return child.bins


def starts(sizes: list[int], capacity: int, rng) -> Iterator[list[list[int]]]:
    """A first population: best fit decreasing, then the same around shuffled beginnings."""
    for k in range(POPULATION):
        some = rng.permutation(len(sizes))[:len(sizes) // 8].tolist() if k else []
        start = Bins([], sizes, capacity)
        for i in some:
            start.put([i])
        start.put(sorted(set(range(len(sizes))).difference(some)))
        yield start.bins


def evolve(population: list[list[list[int]]], sizes: list[int], capacity: int, seed: int) -> list[list[list[int]]]:
    """One epoch of an island, begun anew where ``population`` is empty; best
    first. Ends early at the lower bound."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    ranked = [(fitness(b, sizes, capacity), b) for b in population or starts(sizes, capacity, rng)]
    rank = lambda x: x[0]
    ranked.sort(key=rank, reverse=True)
    for _ in range(CHILDREN):
        if -ranked[0][0][0] <= least or len(ranked) < 2:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = mutate(crossover(ranked[a][1], ranked[b][1], sizes, capacity, rng), sizes, capacity, rng)
        ranked = sorted([*ranked, (fitness(child, sizes, capacity), child)], key=rank, reverse=True)[:POPULATION]
    return [b for _, b in ranked]


def unsettled(packed: Bins) -> list[bool]:
    """Of each bin whether it is packed again: the poorly filled ones, and as
    many others, those of the most pieces, whose small pieces fill gaps."""
    poor = [r > (1 - WELL_FILLED) * packed.capacity for r in packed.room]
    small = set(sorted((k for k, p in enumerate(poor) if not p), key=lambda k: (-len(packed.bins[k]), k))[:sum(poor)])
    return [p or k in small for k, p in enumerate(poor)]


def _encode(bins: list[list[int]]) -> list[int]:
    """The bin number of each piece."""
    out = [0] * sum(map(len, bins))
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _decode(numbers) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        bins[k].append(i)
    return [b for b in bins if b]


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with block: about ``size`` rows each, dealt by hash."""
    blocks = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).cast("long"))


def pack_lengths(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (row, piece, length; all lengths under ``capacity``) with block,
    bin: pieces of equal (block, bin) share a sequence. Every piece's bin comes from
    the islands. What the first blocks leave poorly filled is evolved once more,
    over all of them; these blocks have negative numbers."""

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers = pdf["bin"].tolist()
        order = {b: k for k, b in enumerate(sorted(set(numbers)))}
        again = unsettled(Bins(_decode(numbers), pdf["length"].tolist(), capacity))
        return pdf.assign(again=[again[order[b]] for b in numbers])

    evolved = _islands(_in_blocks(rows.select("row", "piece", "length"), BLOCK), capacity)
    first = checkpoint(evolved.groupBy("block").applyInPandas(mark, "row long, piece int, length long, block long, bin long, again boolean"))
    second = _islands(_in_blocks(first.where("again").select("row", "piece", "length"), BLOCK), capacity)
    return first.where("not again").drop("again").unionByName(second.withColumn("block", -1 - F.col("block")))


def _islands(dealt: DataFrame, capacity: int) -> DataFrame:
    """``dealt`` (row, piece, length, block) with bin.

    A block's lengths go through the islands as arrays, one row for each block
    and island, so that what an epoch shuffles is four bytes a piece."""
    state = "block long, island int, rows array<long>, pieces array<int>, sizes array<int>, population array<array<int>>, guest array<int>"

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for block, island, rows, pcs, sizes, population, guest in pdf.itertuples(index=False):
                    sizes = sizes.tolist()
                    kept = [_decode(x.tolist()) for x in population]
                    if guest is not None:
                        kept = [_decode(guest.tolist()), *kept[:POPULATION - 1]]
                    seed = zlib.crc32(f"{block} {island} {number}".encode())
                    out.append((block, island, rows, pcs, sizes, [_encode(b) for b in evolve(kept, sizes, capacity, seed)], None))
                yield pd.DataFrame(out, columns=pdf.columns)

        return run

    one = F.struct("row", "piece", F.col("length").cast("int").alias("size"))
    groups = dealt.groupBy("block").agg(F.array_sort(F.collect_list(one)).alias("all"))
    islands = groups.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("all.row").alias("rows"), F.col("all.piece").alias("pieces"),
                            F.col("all.size").alias("sizes"), F.array().cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("guest"))
    tasks = partitions(dealt.sparkSession)  # by number: a few bytes of state are much work
    for number in range(EPOCHS):
        islands = checkpoint(islands.repartition(tasks, "block", "island").mapInPandas(epoch(number), state))
        if number < EPOCHS - 1:
            # elites go round: island k's to island k + 1
            moved = islands.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("population")[0].alias("visitor"))
            islands = islands.drop("guest").join(moved, ["block", "island"]).withColumnRenamed("visitor", "guest")
    elite = F.col("population")[0]
    best = islands.groupBy("block").agg(F.min_by(F.struct("rows", "pieces", "sizes", elite.alias("elite")), F.struct(F.size(F.array_distinct(elite)), "island")).alias("s"))
    each = best.select("block", F.explode(F.arrays_zip("s.rows", "s.pieces", "s.sizes", "s.elite")).alias("x"))
    return each.select(F.col("x")["rows"].alias("row"), F.col("x")["pieces"].alias("piece"), F.col("x")["sizes"].cast("long").alias("length"), "block", F.col("x")["elite"].cast("long").alias("bin"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for
    each piece; sequence ids are any numbers, offsets are gapless."""
    cut = checkpoint(pieces(docs, doc_id, text, tokenizer, capacity))
    whole, part = cut.where(F.col("length") == capacity), cut.where(F.col("length") < capacity)
    packed = checkpoint(pack_lengths(part.select("row", "piece", "length"), capacity))
    # offsets: the running sum within a sequence, which is at most ``capacity`` pieces
    listed = packed.groupBy("block", "bin").agg(F.array_sort(F.collect_list(F.struct("row", "piece", "length"))).alias("all"))
    begun = F.transform("all", lambda x, i: F.struct(x["row"].alias("row"), x["piece"].alias("piece"), F.aggregate(F.slice("all", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["length"]).alias("offset")))
    placed = listed.select("block", "bin", F.explode(begun).alias("x"))
    number = F.when(F.col("block") >= 0, F.col("block") * 2).otherwise(-F.col("block") * 2 - 1)
    placed = placed.select(F.col("x.row").alias("row"), F.col("x.piece").alias("piece"), (number * (1 << 24) + F.col("bin")).alias("sequence_id"), F.col("x.offset").alias("offset"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = whole.select(*columns[:5], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return part.join(placed, ["row", "piece"]).select(*columns).unionByName(full)


def op3_best_fit_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs)
