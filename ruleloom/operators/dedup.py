"""Duplicates by hash, one-edit neighbours, and overlap with held-out items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.text import one_edit
from ruleloom.sources.shared import kept


def by_hash(rows: DataFrame, id_: str, value: Column) -> DataFrame:
    """(kept_id, copies): one row for each distinct value; partial minima first."""
    return rows.groupBy(F.sha2(value, 256).alias("digest")).agg(F.min(id_).alias("kept_id"), F.count("*").alias("copies")).drop("digest")


def deletions(word: Column) -> Column:
    """The word and all it becomes by leaving out one letter: words within one
    edit or one swap of neighbours share at least one of these."""
    n = F.length(word)
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))))


def one_edit_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) of words within one edit. Words meet on a deletion that
    they share, an equal key, and never all of one length."""
    l = left.select(a, F.explode(deletions(F.col(a))).alias("d"))  # noqa: E741
    r = right.select(b, F.explode(deletions(F.col(b))).alias("d"))
    return l.join(r, "d").where(one_edit(F.col(a), F.col(b))).select(a, b).distinct()


def unique_corrections(words: DataFrame, vocabulary: DataFrame, word: str) -> DataFrame:
    """(word, correction) for unknown words with exactly one vocabulary word within one edit."""
    known = vocabulary.select(F.col(word).alias("correction"))
    unknown = words.join(vocabulary.select(word), word, "left_anti").select(word).distinct()
    found = one_edit_pairs(unknown, known, word, "correction")
    return found.groupBy(word).agg(F.min("correction").alias("correction"), F.count("*").alias("n")).where("n = 1").drop("n")


def near_words(words: DataFrame) -> DataFrame:
    """(u, v) of numbered words (n, word) within one letter put in, left out or changed
    of each other, u under v. Words meet on a deletion that they share, which so many
    words have as there are letters and places, whatever the number of words."""
    d = words.select("n", "word", F.explode(deletions(F.col("word"))).alias("d"))
    l, r = d.select(F.col("n").alias("u"), F.col("word").alias("a"), "d"), d.select(F.col("n").alias("v"), F.col("word").alias("b"), "d")  # noqa: E741
    return l.join(r, "d").where((F.col("u") < F.col("v")) & (F.levenshtein("a", "b", 1) >= 0)).select("u", "v").distinct()


def spread(rows: DataFrame, word: str, order: list[str]) -> DataFrame:
    """Rows whose word, in lower case, is two edits and more from that of every row
    kept before it, in the order of ``order`` and then of the word: what a filter that
    goes through them one by one keeps. Of equal words the first row is kept.

    All words are decided at once, round by round: one that no undecided earlier
    word is near to is kept, and what is near a kept one is dropped. Only pairs of
    near words are looked at, and each round is left with those of undecided words, so
    there are as many rounds as the longest row of words that wait for each other.
    Null words are dropped; an empty word is a word."""
    first = rows.where(F.col(word).isNotNull()).groupBy(F.lower(word).alias("word")).agg(F.min(F.struct(*order, F.col(word).alias("as_written"))).alias("at"))
    # a number that grows with the order: ranges of it are sorted apart, and hold whole values
    numbered = kept(first.repartitionByRange("at").sortWithinPartitions("at").withColumn("n", F.monotonically_increasing_id()))
    pairs, gone = kept(near_words(numbered)), None
    while not pairs.isEmpty():
        waiting = pairs.select(F.col("v").alias("w")).distinct()
        stays = pairs.select("u").distinct().join(waiting, F.col("u") == F.col("w"), "left_anti")
        falls = kept(pairs.join(stays, "u", "left_semi").select(F.col("v").alias("w")).distinct())
        gone = falls if gone is None else gone.unionByName(falls)
        # a dropped word keeps no other from staying; pairs of kept words have done their work
        pairs = kept(pairs.join(falls, F.col("u") == F.col("w"), "left_anti").join(falls, F.col("v") == F.col("w"), "left_anti"))
    left = numbered if gone is None else numbered.join(gone, F.col("n") == F.col("w"), "left_anti")
    chosen = left.select("at.*")
    return rows.join(chosen.withColumnsRenamed({c: f"chosen_{c}" for c in order}), [rows[c].eqNullSafe(F.col(f"chosen_{c}")) for c in order] + [rows[word] == F.col("as_written")], "left_semi").dropDuplicates([*order, word])


#: Characters of items in one broadcast: each so many cost a pass over the texts.
ITEM_CHARS = 8_000_000


def _item_groups(items: DataFrame, item_id: str, text: str) -> Iterator[dict[str, list]]:
    """Text to ids, in groups of ITEM_CHARS characters (one item may be longer)."""
    group: dict[str, list] = {}
    size = 0
    for i, t in items.select(item_id, text).where(F.length(text) > 0).toLocalIterator():
        if group and size + len(t) > ITEM_CHARS:
            yield group
            group, size = {}, 0
        group.setdefault(t, []).append(i)
        size += len(t)
    if group:
        yield group


def contained(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id): items whose text stands in a document's text, character by
    character. One automaton finds all items of a group in one pass over a text.
    Null and empty texts contain nothing and are in nothing."""
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}"
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for group in _item_groups(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            found = ahocorasick.Automaton()
            for t, ids in shared.value.items():
                found.add_word(t, ids)
            found.make_automaton()
            for pdf in batches:
                rows = {(d, i) for d, t in zip(pdf[doc_id], pdf[text]) if t for _, ids in found.iter(t) for i in ids}
                yield pd.DataFrame(sorted(rows), columns=[doc_id, item_id])

        out = out.unionByName(docs.select(doc_id, text).mapInPandas(run, schema))
    return out.distinct()
