"""N-gram Jaccard join by a MinHash LSH forest.

1. A text's set of five-word shingles is hashed to 64 bits. Texts of equal
   sets are copies: a class.
2. Each class has a path of DEPTH MinHash values in each of TREES tries. A
   trie is its sorted paths: all (tree, path) rows are sorted by range, and the
   common prefix of a path with the one before it is where they part.
3. In each trie every class goes up from its leaf, node by node, to the one of
   ``floor_depth`` values, at which pairs at the threshold meet with probability
   LEAST_RECALL, whatever the documents. No count and no length comes from a
   sample; ``recall`` measures what it comes to, for reports alone.
4. Classes under a node link to one of them; components of these links are
   candidate groups.
5. Within a candidate group all pairs are verified exactly on their shingle
   sets. A large group is dealt by size of set (sets at the threshold differ by
   a quarter at most) into packed blocks of bounded size, and pairs of blocks
   are compared: no pair becomes a row, no text is sent twice.
6. Components of the verified links are the groups.

A text of one to four words is one shingle. A null text, or one without a
word, has none: it is linked to nothing and is a group of its own. Repeated
rows are copies. Rows with a null id keep null ids and take no part. Where rows
of one id have different texts, each text is classed by itself. Ties go to the
smaller id, then to the smaller hash of the text. Empty tables give no rows;
other columns of the input take no part and stay in ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import fresh, partitions, words, written
from ruleloom.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL, LEAST_RECALL = 24, 10, 0.999, 0.9999
#: Texts that ``recall`` is reported with, and the characters of one at most.
PROBES, PROBE_CHARACTERS = 512, 16_384
#: Classes of a block, shingles of a block or task, about, and tasks over which the rows of one group are dealt where they join what is known of it.
TILE, TASK_SHINGLES, SALTS = 256, 1_000_000, 16
#: Texts that a task takes out of an Arrow batch at once.
AT_ONCE = 500

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)
_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def floor_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = LEAST_RECALL) -> int:
    """The longest prefix at which pairs of similarity ``threshold`` meet with
    probability ``target``, whatever the documents."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


class Shingler:
    """Texts to sorted sets of 64-bit shingle hashes; remembers words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None, n: int = SHINGLE) -> np.ndarray:
        tokens = words(text)
        if not tokens:
            return np.zeros(0, np.uint64)
        if len(self.known) > 150_000:
            self.known.clear()
        known = self.known
        for w in set(tokens):
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        ids = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        n = min(n, len(ids))
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ ids[k:len(ids) - n + 1 + k]) * _P
            h ^= h >> np.uint64(29)
        return np.unique(h * _Q)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES paths of DEPTH MinHash values, of each of which 16 bits are kept."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2_048):
        part = shingles[at:at + 2_048]
        for i in range(0, TREES * DEPTH, 32):  # a block of both stays in cache
            h = part[None, :] * _A[i:i + 32, None] + _B[i:i + 32, None]
            low[i:i + 32] = np.minimum(low[i:i + 32], h.min(1))
    return ((low * _Q) >> np.uint64(48)).astype("<u2").reshape(TREES, DEPTH)


def agreed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values that paths, the rows of ``a`` and ``b``, have in common from their begin."""
    return np.minimum.accumulate(a == b, axis=-1).sum(-1)


def at_threshold(common: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` shingles with ``common`` ones are linked; in
    integers, without rounding."""
    return common * 10 >= (a + b - common) * round(THRESHOLD * 10)


class Probes:
    """Texts whose links with all documents are found without any trie."""

    def __init__(self, texts: list[str]) -> None:
        shingler = Shingler()
        sets = {s.tobytes(): s for s in map(shingler, texts) if len(s)}
        self.sets = list(sets.values())
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.paths = [signature(s) for s in self.sets]
        flat, owner = (np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.shingles, first = np.unique(flat[order], return_index=True)
        self.first, self.last = first, np.append(first[1:], len(flat))

    def links(self, shingles: np.ndarray, path: np.ndarray) -> list[int]:
        """For each probe that a set is linked with, but for its own class: the
        longest prefix that they share in a trie."""
        if not len(self.shingles):
            return []
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        at = at[self.shingles[at] == shingles]
        if len(at) * 10 < self.sizes.min() * 8:
            return []
        owners = [self.owner[self.first[k]:self.last[k]] for k in at.tolist()]
        common = np.bincount(np.concatenate(owners), minlength=len(self.sizes)) if owners else np.zeros(len(self.sizes), np.int64)
        hits = np.flatnonzero(at_threshold(common, len(shingles), self.sizes) & ((common < len(shingles)) | (common < self.sizes)))
        return [int(agreed(self.paths[k], path).max()) for k in hits]


def draw_probes(docs: DataFrame, text: str) -> Probes:
    """PROBES distinct texts, those of smallest hash, none of them longer than
    PROBE_CHARACTERS: what is broadcast has a bound."""
    t = docs.select(F.col(text).alias("t")).where(F.length("t").between(1, PROBE_CHARACTERS)).withColumn("h", F.xxhash64("t"))
    smallest = [r["h"] for r in t.select("h").distinct().orderBy("h").limit(PROBES).collect()]
    found = t.where(F.col("h").isin(smallest)).groupBy("h").agg(F.min("t").alias("t")).collect() if smallest else []
    return Probes([r["t"] for r in sorted(found)])


ROWS = "id long, mark long, digest binary, size int, paths binary, met array<int>"


def features(docs: DataFrame, doc_id: str, text: str, measured: bool = True) -> DataFrame:
    """ROWS: one for each row of ``docs``. ``mark`` is a hash of the text; digest,
    of the shingle set, is null without a word; met is as in ``Probes.links``, and
    empty unless recall is ``measured``."""
    shared = docs.sparkSession.sparkContext.broadcast(draw_probes(docs, text) if measured else Probes([]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cached, probes = Shingler(), {}, shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):  # so few texts are Python's own at a time
                part = batch.slice(at, AT_ONCE)
                out = []
                for t in part.column("t").to_pylist():
                    s = shingler(t)
                    if not len(s):
                        out.append((None, 0, None, None))
                        continue
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if d not in cached:
                        if len(cached) > 8_000:
                            cached.clear()
                        path = signature(s)
                        cached[d] = path.tobytes(), probes.links(s, path)
                    out.append((d, len(s), *cached[d]))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), *columns], names=_columns(ROWS))

    return _marked(docs, F.col(doc_id), F.col(text)).mapInArrow(run, ROWS)


def _marked(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    return docs.select(doc_id.cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("t"))


def recall(classes: DataFrame) -> dict[int, tuple[int, int]]:
    """For each prefix length: links of the probes that meet at it, and all of them."""
    counts = {r["at"]: r["n"] for r in classes.select(F.explode("met").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect()}
    return {d: (sum(n for at, n in counts.items() if at >= d), sum(counts.values())) for d in range(1, DEPTH + 1)}


def adapted_depth(measured: dict[int, tuple[int, int]]) -> int:
    """The longest prefix whose measured recall reaches the target even if one more link was
    missed; a report of how far prefixes could stay, by which nothing is joined."""
    least = floor_depth()
    for depth in range(DEPTH, least, -1):
        met, links = measured[depth]
        if met >= TARGET_RECALL * (links + 1):
            return depth
    return least


EDGES = "u long, v long, part int, tree int, path binary"


def neighbours(sorted_paths: DataFrame, depth: int) -> DataFrame:
    """EDGES of (tree, path, node) rows, with paths of ``depth`` values, that lie in
    their order: of each row with the first one, so for equal paths the smallest
    one, under the node of the trie at which it parts from the row before it.
    Rows that part above ``floor_depth`` have none. Partitions give their ends, to be
    linked with the next ones', as rows with a ``part``."""
    least = floor_depth()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, before = TaskContext.get().partitionId(), None, None
        heads = dict.fromkeys(range(least, depth + 1), 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree, node = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            path = np.frombuffer(b"".join(batch.column("path").to_pylist()), "<u2").reshape(n, depth)
            if first is None:
                first = int(tree[0]), path[0].tobytes(), int(node[0])
                before = np.full(1, -1, tree.dtype), path[:1]
            agree = _agree(np.concatenate([before[0], tree]), np.concatenate([before[1], path]))
            before = tree[-1:], path[-1:]
            u = np.zeros(n, np.int64)
            for d in heads:  # the first row under each row's node of depth d
                begun = np.maximum.accumulate(np.where(agree < d, np.arange(n), -1))
                head = np.where(begun >= 0, node[begun], heads[d])
                u[agree == d] = head[agree == d]
                heads[d] = head[-1]
            at = np.flatnonzero(agree >= least)
            yield _edges(u[at], node[at])
        if first is not None:
            trees, paths, nodes = zip(first, (int(tree[-1]), path[-1].tobytes(), int(node[-1])))
            yield _edges(nodes, [0, 1], [part] * 2, trees, paths)

    return sorted_paths.mapInArrow(run, EDGES)


def _agree(tree: np.ndarray, path: np.ndarray) -> np.ndarray:
    return np.where(tree[1:] == tree[:-1], agreed(path[1:], path[:-1]), 0)


def _edges(u, v, part=None, tree=None, path=None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    none = [None] * len(u)
    return pa.RecordBatch.from_arrays([pa.array(none if c is None else c, k) for c, k in zip((u, v, part, tree, path), kinds)], names=_columns(EDGES))


def candidates(classes: DataFrame) -> DataFrame:
    """(u, v): links of classes that meet in the forest, at any node down to ``floor_depth``."""
    spark, least = classes.sparkSession, floor_depth()
    width = 2 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    paths = classes.select("node", "paths", tree).select("tree", F.substring("paths", F.col("tree") * width + 1, F.lit(width)).alias("path"), "node")
    order = ["tree", "path", "node"]  # the node parts equal paths: no partition is hot
    found = written(neighbours(paths.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order), DEPTH))
    edges = found.where("part is null").select("u", "v")
    ends = sorted(found.where("part is not null").select("part", "v", "u", "tree", "path").collect())  # two for each partition
    across = []
    for (*_, u, t1, p1), (*_, v, t2, p2) in zip(ends[1::2], ends[2::2]):
        p = np.frombuffer(p1, "<u2")[None], np.frombuffer(p2, "<u2")[None]
        if t1 == t2 and int(agreed(*p)[0]) >= least and u != v:
            across.append((u, v))
    if across:
        edges = edges.unionByName(spark.createDataFrame(across, "u long, v long"))
    return edges.distinct()


def verify(sets: list[np.ndarray], block: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each of ``sets`` at THRESHOLD, and the first of those it is
    connected with. Pairs within one block count only if ``same``."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((np.arange(n), block))
    starts = np.concatenate([[0], np.cumsum(sizes[order])])
    vocabulary, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark = np.zeros(len(vocabulary), np.int32)
    links, parent = np.zeros(n, np.int64), np.arange(n)
    first_of_b = int(np.searchsorted(block[order], 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for p in range(n if same else first_of_b):
        lo = p + 1 if same else first_of_b
        if lo >= n:
            break
        own = flat[starts[p]:starts[p + 1]]
        mark[own] = 1
        hits = np.add.reduceat(mark[flat[starts[lo]:]], starts[lo:-1] - starts[lo])
        mark[own] = 0
        found = np.flatnonzero(at_threshold(hits, len(own), sizes[order[lo:]])) + lo
        links[order[p]] += len(found)
        links[order[found]] += 1
        a = find(int(order[p]))
        for q in order[found]:
            b = find(int(q))
            if a != b:
                a, b = min(a, b), max(a, b)
                parent[b] = a
    return links, np.array([find(i) for i in range(n)])


FOUND = "node long, n long, to long"
BLOCK = "label long, band int, salt int, nodes binary, sizes binary, shingles binary, places binary"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole candidate groups, of any number, to FOUND; or a block of a large one to BLOCK."""
    pdf = pdf.drop_duplicates("node").sort_values("node")
    if pdf["task"].iloc[0] < 0:
        return _packed_block(pdf).reindex(columns=_columns(FOUND) + _columns(BLOCK))
    shingler, out = Shingler(), []
    for _, part in pdf.groupby("label", sort=False):
        nodes = part["node"].to_numpy()
        links, root = verify([shingler(t) for t in part["t"]], np.zeros(len(part), int), True)
        out.append(pd.DataFrame({"node": nodes, "n": links, "to": nodes[root]}))
    return pd.concat(out).reindex(columns=_columns(FOUND) + _columns(BLOCK))


def _packed_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sets of a block: its shingles once, and where each set has them."""
    import zstandard

    shingler = Shingler()
    sets = [shingler(t) for t in pdf["t"]]
    shingles, places = np.unique(np.concatenate(sets), return_inverse=True)
    pack = zstandard.ZstdCompressor(level=1).compress
    one = pdf.iloc[0]
    row = (one["label"], one["band"], one["salt"], pdf["node"].to_numpy(np.int64).tobytes(), np.array([len(s) for s in sets], "<i4").tobytes(), pack(shingles.tobytes()), pack(places.astype("<u4").tobytes()))
    return pd.DataFrame([row], columns=_columns(BLOCK))


def _unpacked(row) -> tuple[np.ndarray, list[np.ndarray]]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    flat = np.frombuffer(expand(row.shingles), np.uint64)[np.frombuffer(expand(row.places), "<u4")]
    return np.frombuffer(row.nodes, np.int64), np.split(flat, np.cumsum(np.frombuffer(row.sizes, "<i4"))[:-1])


def _pair_of_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block with itself, or two with each other, to FOUND."""
    blocks = [_unpacked(r) for r in pdf.sort_values(["band", "salt"]).itertuples(index=False)]
    nodes, sets = np.concatenate([b[0] for b in blocks]), [s for b in blocks for s in b[1]]
    links, root = verify(sets, np.repeat(np.arange(len(blocks)), [len(b[1]) for b in blocks]), len(blocks) == 1)
    return pd.DataFrame({"node": nodes, "n": links, "to": nodes[root]})


def _with_label(rows: DataFrame, of_label: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the columns of ``of_label``, which has a row for each label (and
    ``keys``). A label that very many rows have is dealt over SALTS of them."""
    salted = rows.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    told = of_label.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(told, ["label", *keys, "deal"]).drop("deal")


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """FOUND for the classes of ``groups`` (node, label), whose texts are in ``docs`` (id, mark, t)."""
    spark = docs.sparkSession
    # sets of a band and those of a band further on differ by more than the threshold allows
    band = F.floor(F.log("size") / math.log(1.01 / THRESHOLD)).cast("int")
    members = written(groups.join(classes.select("node", "id", "mark", "size"), "node").withColumn("band", band))
    large = (F.col("n") > TILE) | (F.col("shingles") > TASK_SHINGLES)
    total = written(members.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).select("label", "shingles", large.alias("large")))
    shingles = total.where("not large").agg(F.sum("shingles")).first()[0] or 0
    tasks = max(partitions(spark), -(-shingles // TASK_SHINGLES))
    told = _with_label(members, total.select("label", "large"))
    dealt = told.where("not large").select("id", "mark", "node", "label", F.lit(0).alias("band"), F.lit(0).alias("salt"), F.pmod(F.xxhash64("label"), F.lit(tasks)).alias("task"))
    some_large = not total.where("large").isEmpty()
    if some_large:
        salts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TASK_SHINGLES)).cast("int").alias("salts")
        hot = written(told.where("large"))
        bands = written(hot.groupBy("label", "band").agg(salts))
        block = _with_label(hot, bands, "band").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), "salts").cast("int"))
        dealt = dealt.unionByName(block.select("id", "mark", "node", "label", "band", "salt", F.lit(-1).cast("long").alias("task")))
    texts = docs.join(dealt, ["id", "mark"]).select("node", "label", "band", "salt", "t", "task").withColumn("of", F.when(F.col("task") < 0, F.col("label")))
    found = written(texts.groupBy("task", "of", "band", "salt").applyInPandas(_group, f"{FOUND}, {BLOCK}"))
    blocks, found = found.where("nodes is not null").select(*_columns(BLOCK)), found.where("node is not null").select(*_columns(FOUND))
    if not some_large:
        return found

    def of(step: int, name: str) -> DataFrame:
        return bands.select("label", (F.col("band") - step).alias("band"), F.col("salts").alias(name))

    known = blocks.join(bands, ["label", "band"]).join(of(1, "above"), ["label", "band"], "left").join(of(-1, "below"), ["label", "band"], "left")

    def others(count: str) -> Column:
        return F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))

    own = F.transform(others("salts"), lambda s: F.struct(F.col("band").alias("a"), F.least("salt", s).alias("i"), F.col("band").alias("b"), F.greatest("salt", s).alias("j")))
    up = F.transform(others("above"), lambda s: F.struct(F.col("band").alias("a"), F.col("salt").alias("i"), (F.col("band") + 1).alias("b"), s.alias("j")))
    down = F.transform(others("below"), lambda s: F.struct((F.col("band") - 1).alias("a"), s.alias("i"), F.col("band").alias("b"), F.col("salt").alias("j")))
    met = known.select("*", F.explode(F.concat(own, up, down)).alias("pair"))
    return found.unionByName(met.select(*_columns(BLOCK), "pair").groupBy("label", "pair").applyInPandas(_pair_of_blocks, FOUND))


def near_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, class_id, class_mark, copy_id, n_links) for every row of
    ``docs``: what ``near_links`` has, and the hashes of a row's own text and of
    the text that represents its group."""
    rows = written(features(docs, doc_id, text, measured=False))
    one = F.struct("id", "mark")
    classes = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min(one).alias("one"), F.min_by(F.struct("size", "paths"), one).alias("of"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "one.id", "one.mark", "of.size", "of.paths"))
    groups = components(candidates(classes))
    found = written(verified(_marked(docs, F.col(doc_id), F.col(text)), classes, groups))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    of_class = written(classes.select("digest", "node", one.alias("copy")).join(links, "node", "left").join(linked, "node", "left"))
    grouped = of_class.where("label is not null")
    least = grouped.groupBy("label").agg(F.min("copy").alias("class"))
    of_class = _with_label(grouped, least).unionByName(of_class.where("label is null").withColumn("class", F.col("copy")))
    of_class = written(of_class.select("digest", "copy", "class", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    out = rows.select("id", "mark", "digest").join(of_class, "digest", "left")
    return out.select("id", "mark", F.coalesce("class.id", "id").alias("class_id"), F.coalesce("class.mark", "mark").alias("class_mark"), F.coalesce("copy.id", "id").alias("copy_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def near_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, copy_id, n_links) for every row of ``docs``. class_id is
    the smallest id of the group of linked texts, copy_id the smallest id of an
    equal shingle set, n_links the number of other such sets at THRESHOLD or
    more."""
    return near_rows(docs, doc_id, text).select("id", "class_id", "copy_id", "n_links")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that of smallest id. Its
    repeated rows are kept once. Rows with a null id all stay."""
    key, mark, drop, drop_mark = fresh(docs, "near_id", "near_mark", "of_group", "of_mark")
    gone = near_rows(docs, doc_id, text).where("id is not null and (id <> class_id or mark <> class_mark)").select(F.col("id").alias(drop), F.col("mark").alias(drop_mark)).distinct()
    known = docs.where(F.col(doc_id).isNotNull()).withColumn(key, F.col(doc_id).cast("long")).withColumn(mark, F.xxhash64(text))
    kept = known.join(gone, (F.col(key) == F.col(drop)) & (F.col(mark) == F.col(drop_mark)), "left_anti").dropDuplicates([key, mark])
    return kept.drop(key, mark).unionByName(docs.where(F.col(doc_id).isNull()))


def op6_ngram_jaccard_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_links(docs).withColumnRenamed("id", "doc_id")
