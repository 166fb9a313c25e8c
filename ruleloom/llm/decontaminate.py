"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

1. Every two consecutive words of a test item are a seed, looked up in every
   whole training text. An alignment that reaches THRESHOLD keeps at least
   ``kept_seeds`` of an item's seeds whole: of m words that match, each break
   between two of them costs a gap or mismatch. So an item may do without its
   commonest seeds, and asks for the rest of that number among its rare ones.
   How common a seed is, is counted over the whole corpus. Items too short for
   this are sought by their single words.
2. A document and an item are candidates at a place where so many rare seeds
   lie together. No copy that reaches THRESHOLD escapes.
3. The item is aligned with the words around each place by Smith-Waterman
   (match 2, mismatch and gap -1). The best score, over the score of the item
   with itself, is the similarity; THRESHOLD or more is a copy, be it edited,
   shortened or with words put in. A copy's words lie within longest_gap() of
   where a seed of it says that the item stands, so its window has all of them.

Words are runs of letters and digits, in lower case. Null and empty texts, items
of fewer than LEAST_WORDS words, and empty tables match nothing. Repeated
rows repeat their matches; of items of equal score the smallest id is named.

The items are broadcast in groups of at most ITEM_WORDS words, so that what is
broadcast is bounded however many items there are: each group is one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import fresh, words

THRESHOLD, MATCH, MISMATCH, GAP = 0.6, 2, -1, -1
#: Words of an item at least.
LEAST_WORDS = 3
#: Words of items in one broadcast.
ITEM_WORDS = 2_000_000


def longest_gap(n: int) -> int:
    """Words that can be put into a copy of n words before its score is under THRESHOLD, and one."""
    return int((1 - THRESHOLD) * MATCH * n / -GAP) + 1


def kept_seeds(n: int) -> int:
    """Pairs of consecutive words that every copy of n words has whole: m matches
    with g breaks score 2m - g at most and keep m - 1 - g pairs."""
    return math.ceil((THRESHOLD * MATCH - MATCH + 1) * n - 1 - 1e-9)


class Items:
    """A group of test items, indexed by their seeds.

    ``need`` is the number of an item's seeds that must lie together in a text."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        tokens = [(i, w) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) if i is not None and len(w := words(t)) >= LEAST_WORDS]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in tokens for w in ws}))}
        self.ids = np.array([i for i, _ in tokens], np.int64)
        self.words = [np.array([self.number[w] for w in ws], np.int64) for _, ws in tokens]
        kept = np.array([kept_seeds(len(w)) for w in self.words], np.int64)
        self.single = kept < 1  # no pair is sure to be whole: words are seeds
        self.need = np.where(self.single, [math.ceil(THRESHOLD * len(w) - 1e-9) for w in self.words] or 0, kept)
        seeds = [w * (len(self.number) + 1) if one else self.pairs(w) for w, one in zip(self.words, self.single)]
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, int)
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.int64)
        self._index(flat, owner, place)

    def _index(self, flat: np.ndarray, owner: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.place = flat[order], owner[order], place[order]
        self.unique = np.unique(flat)

    def pairs(self, numbers: np.ndarray) -> np.ndarray:
        """A number for each two consecutive words; negative where one is unknown."""
        return np.where((numbers[:-1] > 0) & (numbers[1:] > 0), numbers[:-1] * (len(self.number) + 1) + numbers[1:], -1)

    def spare(self) -> np.ndarray:
        """Of each item, the seeds that it can do without."""
        return np.where(self.single, 0, self.need // 2)

    def rare(self, frequency: dict[int, int]) -> Items:
        """Leaves out each item's commonest seeds, as many as it can do without."""
        df = np.array([frequency.get(int(s), 0) for s in self.flat], np.int64)
        order = np.lexsort((self.place, -df, self.owner))
        owner = self.owner[order]
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        stay = order[nth >= self.spare()[owner]]
        self.need = self.need - self.spare()
        self._index(self.flat[stay], self.owner[stay], self.place[stay])
        return self

    def read(self, text: str | None) -> np.ndarray:
        """The words' numbers; 0 for words that no item has."""
        tokens = words(text)
        get = self.number.get
        return np.fromiter((get(w, 0) for w in tokens), np.int64, len(tokens))

    def found(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text and the seeds there."""
        if not len(self.unique) or len(numbers) < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = []
        for seeds in [self.pairs(numbers), *([numbers * (len(self.number) + 1)] if self.single.any() else [])]:
            at = np.flatnonzero(seeds > 0)
            near = np.minimum(np.searchsorted(self.unique, seeds[at]), len(self.unique) - 1)
            at = at[self.unique[near] == seeds[at]]
            out.append((at, seeds[at]))
        return np.concatenate([a for a, _ in out]), np.concatenate([s for _, s in out])


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local scores of ``item`` with each row of ``windows`` (padded with
    -1), and where in the row the best alignment ends."""
    n, m = windows.shape
    before = np.zeros((n, m + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    steps = np.arange(m + 1, dtype=np.int32) * -GAP
    for w in item:
        row = np.zeros((n, m + 1), np.int32)
        row[:, 1:] = np.maximum(before[:, :-1] + np.where(windows == w, MATCH, MISMATCH), before[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        # gaps along the row: each cell is at least what any cell to its left has, less the distance
        row = np.maximum.accumulate(row + steps, axis=1) - steps
        top = row.argmax(1)
        score = row[np.arange(n), top]
        end = np.where(score > best, top, end)
        best = np.maximum(best, score)
        before = row
    return best, end


def matches(numbers: np.ndarray, items: Items) -> list[tuple[int, float, int]]:
    """(item number, similarity, last word) of the items of which the text has a copy."""
    at, seeds = items.found(numbers)
    if not len(at):
        return []
    lo, hi = np.searchsorted(items.flat, seeds), np.searchsorted(items.flat, seeds, "right")
    rows = np.repeat(at, hi - lo), np.arange((hi - lo).sum()) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)
    owner, place = items.owner[rows[1]], items.place[rows[1]]
    enough = np.bincount(owner, minlength=len(items.ids)) >= items.need
    use = enough[owner]
    begin, owner, place = (rows[0] - place)[use], owner[use], place[use]
    order = np.lexsort((begin, owner))
    begin, owner, place = begin[order], owner[order], place[order]
    out = []
    for k, a, z in zip(*_runs(owner)):
        item = items.words[k]
        n, slack = len(item), longest_gap(len(item))
        starts = begin[a:z]
        # places closer than the slack share a window; each window has room for gaps on both sides
        first = np.concatenate([[True], np.diff(starts) > slack])
        window = np.cumsum(first) - 1
        seen = np.unique(window * n + place[a:z]) // n  # each of the item's seeds once
        full = np.bincount(seen, minlength=window[-1] + 1) >= items.need[k]
        left = starts[first][full] - slack
        right = starts[np.append(first[1:], True)][full] + n + slack
        left, right = np.maximum(left, 0), np.minimum(right, len(numbers))
        if not len(left):
            continue
        need = (THRESHOLD * MATCH * n)
        inside = np.concatenate([[0], np.cumsum(np.isin(numbers, item))])
        keep = (inside[right] - inside[left]) * MATCH >= need  # else even all of its words don't make the score
        left, right = left[keep], right[keep]
        most = None
        for piece in np.array_split(np.arange(len(left)), max(1, len(left) // 256)):
            if not len(piece):
                continue
            windows = np.full((len(piece), int((right - left)[piece].max())), -1, np.int64)
            for r, p in enumerate(piece):
                windows[r, :right[p] - left[p]] = numbers[left[p]:right[p]]
            score, end = align(item, windows)
            top = int(score.argmax())
            if score[top] >= need and (most is None or score[top] > most[0]):
                most = score[top], int(left[piece[top]] + end[top] - 1)
        if most:
            out.append((int(k), float(most[0]) / (MATCH * n), most[1]))
    return out


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Of sorted values: each, where its run begins and where it ends."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)][:len(first)]


def item_groups(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The items in groups of at most ITEM_WORDS words (one item may be longer)."""
    group: list[tuple[int, str]] = []
    size = 0
    for row in items.select(F.col(item_id).cast("long"), text).where(F.col(text).isNotNull()).toLocalIterator():
        n = len(words(row[1]))
        if group and size + n > ITEM_WORDS:
            yield Items(group)
            group, size = [], 0
        group.append((row[0], row[1]))
        size += n
    if group:
        yield Items(group)


def _frequencies(docs: DataFrame, text: str, shared) -> dict[int, int]:
    """Over the whole corpus, how many documents have each seed: summed up in
    each task, so that a task sends a row for a seed at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, total = shared.value, np.zeros(len(shared.value.unique), np.int64)
        for pdf in batches:
            for t in pdf["t"]:
                total[np.searchsorted(items.unique, np.unique(items.found(items.read(t))[1]))] += 1
        k = np.flatnonzero(total)
        yield pd.DataFrame({"seed": items.unique[k], "n": total[k]})

    counted = docs.select(F.col(text).alias("t")).where("t is not null").mapInPandas(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return {r["seed"]: r["n"] for r in counted.collect()}  # as many rows as the group has seeds


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, similarity, last_word): a row for each document and each item
    of which it has a copy; last_word is where the best alignment ends."""
    spark, schema = docs.sparkSession, "id long, item_id long, similarity double, last_word long"
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where("t is not null")
    out = spark.createDataFrame([], schema)
    for group in item_groups(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(group)
        if group.spare().any():
            shared = spark.sparkContext.broadcast(group.rare(_frequencies(docs, text, shared)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = [(i, int(shared.value.ids[k]), s, e) for i, t in zip(pdf["id"], pdf["t"]) for k, s, e in matches(shared.value.read(t), shared.value)]
                yield pd.DataFrame(found, columns=["id", "item_id", "similarity", "last_word"])

        out = out.unionByName(rows.mapInPandas(run, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that have a copy of an item. Rows with a null id all stay."""
    (bad,) = fresh(docs, "bad_id")
    found = contamination(docs, items, doc_id, text).select(F.col("id").alias(bad)).distinct()
    return docs.join(found, docs[doc_id] == found[bad], "left_anti")


def op8_benchmark_decontamination(spark, sf_dir):
    """One row for each document and item of which the document has a copy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")
