"""Language identification by compression.

For each language a zstandard raw-content dictionary is built from its
training texts. A text is encoded once with each dictionary; the language
whose dictionary gives the fewest bytes is chosen. Where the best two are
closer than a margin the choice is marked as not accepted.

Texts are lower-cased and reduced to letters first. A long text is encoded in
blocks, so that its own repetitions don't outweigh the dictionary; all blocks
of the whole text count.

A dictionary is filled with pieces of training texts, one of each text before
a second one of any. A sample of texts gives them; of a text in it every piece
may be taken, wherever it stands.

Null texts and texts without a letter are ``und`` with score 0. Rows with null
language or text teach nothing; repeated rows teach once, and are classified
each. With no training rows all texts are ``und``. Ties go to the language that
sorts first. Extra columns stay; output columns that clash with an existing
name get a leading underscore. More than LANGUAGES languages are an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import crc_mod, fresh

#: Bytes of a language's dictionary, texts that may fill it, characters of a
#: piece, pieces of a language, bytes of a block, zstandard level, and the share
#: of the best size by which the second best must be larger. The driver reads
#: PIECES pieces of each of LANGUAGES languages at most.
DICTIONARY_BYTES, DICTIONARY_ROWS, PIECE, PIECES, LANGUAGES, BLOCK_BYTES, LEVEL, MARGIN = 65_536, 64, 1_024, 80, 1_000, 4_096, 6, 0.02
SCHEMA = "lang_pred string, score double, margin double, accepted boolean"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-cased letters of a text, words parted by one space."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower())
    if not words.replace(" ", "").isalpha():  # signs such as the square count as word characters, but are no letters
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return words.strip().encode("utf-8", "ignore")


def sample_pieces(train: DataFrame, text: str, lang: str) -> DataFrame:
    """(g, order_in_lang, t): PIECES pieces of each language g at most, from
    about three times DICTIONARY_ROWS distinct texts, those of smallest hash.

    The share of hashes that may pass is set from how many distinct texts each
    language has, so that no task receives more than a few times that many rows."""
    t, g, k, n, turn, order = "t", "g", "k", "n", "turn", "order_in_lang"
    rows = train.select(F.col(text).alias(t), F.col(lang).alias(g)).where(F.col(t).rlike(r"\p{L}") & F.col(g).isNotNull())
    keyed = rows.select(g, t, F.xxhash64(t).alias(k))
    counts = keyed.select(g, k).distinct().groupBy(g).agg(F.count("*").alias(n)).limit(LANGUAGES + 1).collect()  # copies of a text count once
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    known = train.sparkSession.createDataFrame([(r[g], min(1.0, 3.0 * DICTIONARY_ROWS / r[n])) for r in counts], f"{g} string, share double")
    few = keyed.join(F.broadcast(known), g).where(F.pmod(F.col(k), F.lit(1 << 40)) < F.col("share") * (1 << 40)).select(g, k, t).dropDuplicates([g, k])
    # one pass over a text gives its pieces, however long it is
    cut = F.explode(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    pieces = few.select(g, k, cut.alias(t)).withColumn("h", F.xxhash64(k, t))
    turns = pieces.withColumn(turn, F.row_number().over(Window.partitionBy(g, k).orderBy("h", t)))
    ranked = turns.withColumn(order, F.row_number().over(Window.partitionBy(g).orderBy(turn, k, "h")))
    return ranked.where(F.col(order) <= PIECES).select(g, order, t)


def fit_dictionaries(train: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Language -> raw content of DICTIONARY_BYTES at most. The driver reads a bounded sample only."""
    found: dict[str, list[bytes]] = {}
    for g, _, t in sorted(sample_pieces(train, text, lang).collect()):
        found.setdefault(g, []).append(letters(t))
    # what is nearest to the end costs fewest bytes to point at; a last piece may be cut
    return {g: b" ".join(parts)[:DICTIONARY_BYTES] for g, parts in found.items()}


def _classifier(dictionaries: dict[str, bytes]):
    import zstandard as z

    names = sorted(dictionaries)
    coders = []
    for g in names:
        d = z.ZstdCompressionDict(dictionaries[g], dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        coders.append(z.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False))

    def classify(text: str | None) -> tuple[str, float, float, bool]:
        body = letters(text)
        if not body or not names:
            return "und", 0.0, 0.0, False
        blocks = [body[i:i + BLOCK_BYTES] for i in range(0, len(body), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
        best = min(range(len(names)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (second - sizes[best]) / sizes[best]
        # sizes are code lengths: the gap in bytes, tempered, as a posterior
        weights = [math.exp(-min(60.0, (s - sizes[best]) / 4)) for s in sizes]
        return names[best], 1 / sum(weights), margin, margin >= MARGIN

    return classify


def predictor(dictionaries: dict[str, bytes], spark):
    """A function of a text column that gives SCHEMA."""
    shared = spark.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = _classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([classify(t) for t in texts], columns=["lang_pred", "score", "margin", "accepted"])

    return F.pandas_udf(run, SCHEMA)


def identify_language(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``df`` with the columns of SCHEMA; only the text is read for them."""
    (hit,) = fresh(df, "hit")
    names = ["lang_pred", "score", "margin", "accepted"]
    out = df.withColumn(hit, predictor(dictionaries, df.sparkSession)(F.col(text)))
    return out.select(*df.columns, *(F.col(hit)[a].alias(b) for a, b in zip(names, fresh(df, *names))))


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32(doc_id as text) mod 4 is 2. A null id is held out."""
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(True))


def op2_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = fit_dictionaries(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify_language(rows, dictionaries).drop("text")
