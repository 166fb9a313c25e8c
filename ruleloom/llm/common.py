"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.sources.shared import shared_dir


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; executors may be lost later."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and
    so is what the optimizer has inferred of it, which a checkpoint keeps and which
    grows without bound where one step after another is checkpointed."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def words(text: str | None) -> list[bytes]:
    """Words of a text in lower case: ASCII letters and digits and all other
    alphabets' characters; what lies between them is dropped."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


#: a-z, 0-9 and bytes over 0x7F stay, A-Z are lowered, the rest is a space.
WORD_TABLE = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
