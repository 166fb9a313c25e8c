"""Readers and sinks of line-delimited and whole-document JSON, CSV and checksums."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.operators.sampling import ranked

CORRUPT = "_corrupt_record"


def strict_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; a bad line is a row whose _corrupt_record holds it."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(schema.add(CORRUPT, "string") if CORRUPT not in schema.names else schema).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def bad_lines(rows: DataFrame) -> DataFrame:
    """(rows, bad) of a tolerant read."""
    return rows.agg(F.count_if(F.col(CORRUPT).isNull()).alias("rows"), F.count_if(F.col(CORRUPT).isNotNull()).alias("bad"))


def audited_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line, problem): each line that isn't blank, with its number
    in its file from 1 and why it is no JSON object, if so. A path that isn't there
    is one row. Lines are numbered block by block: no task has a whole file."""
    shape = "file string, line_no int, line string, problem string"
    if not _there(spark, path):
        return spark.createDataFrame([(path, None, None, "missing file")], shape)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    numbered = ranked(lines, ["file"], ["block", "place"], F.col("block"), "line_no")
    v = F.try_parse_json("line")
    problem = F.when(v.isNull(), "not json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
    return numbered.where(F.trim("line") != "").select("file", "line_no", "line", problem.alias("problem"))


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))


def blind(spark: SparkSession, path: str, allowed: str) -> DataFrame:
    """JSON lines of which only the ``allowed`` fields (a schema) are read: labels
    beside them never reach a row."""
    return spark.read.schema(allowed).json(path)


def last_of_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key, the last by ``order``: a later line replaces an earlier one."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def templates(spark: SparkSession, folder: str, suffix: str = ".json") -> DataFrame:
    """(name, text) of the template files in a folder, sorted by name; files whose
    content is no JSON list are left out."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{suffix}").text(folder)
    named = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
    return named.where(F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("ARRAY"), F.lit(False))).orderBy("name")


def unpacked_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, digest, bytes) of what gzip files under a path hold, inflated in
    blocks; a damaged file has a null digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                digest, size, inflater, rest = hashlib.sha256(), 0, zlib.decompressobj(31), content
                try:
                    while rest:
                        block = inflater.decompress(rest, 1 << 20)
                        digest.update(block)
                        size += len(block)
                        rest = inflater.unconsumed_tail
                        if inflater.eof:
                            rest, inflater = inflater.unused_data, zlib.decompressobj(31)
                    out.append((name.removesuffix(".gz"), digest.hexdigest(), size))
                except zlib.error:
                    out.append((name.removesuffix(".gz"), None, size))
            yield pd.DataFrame(out, columns=["file", "digest", "bytes"])

    return files.mapInPandas(run, "file string, digest string, bytes long")


def documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON documents."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def optional_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``tolerant_lines``; no rows if the path isn't there."""
    if not _there(spark, path):
        return spark.createDataFrame([], T.StructType.fromDDL(schema).add(CORRUPT, "string"))
    return tolerant_lines(spark, path, schema)


def ordered_options(json_text: Column) -> Column:
    """An object's (key, value) pairs in the order of the text."""
    values = F.from_json(json_text, "map<string,string>")
    return F.transform(F.json_object_keys(json_text), lambda k: F.struct(k.alias("key"), values[k].alias("description")))


def has_repeated_key(json_text: Column) -> Column:
    keys = F.json_object_keys(json_text)
    return F.size(keys) != F.size(F.array_distinct(keys))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, digest, bytes) of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))


def verify_checksums(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, state) of files that are missing, unlisted or changed; both have (file, digest)."""
    m = manifest.select("file", F.col("digest").alias("told"))
    state = F.when(F.col("digest").isNull(), "missing").when(F.col("told").isNull(), "unlisted").when(F.col("digest") != F.col("told"), "changed")
    return found.select("file", "digest").join(m, "file", "full").select("file", state.alias("state")).where("state is not null")


def derive_plan(trials: DataFrame, arm: str) -> DataFrame:
    """A plan of one arm with the same trial ids."""
    return trials.withColumn("arm_order", F.array(F.lit(arm)))


def write_once(rows: DataFrame, path: str) -> None:
    """Fails if the path is there."""
    rows.write.mode("errorifexists").json(path)


def write_replacing(rows: DataFrame, path: str) -> None:
    """Writes beside the path and then takes its place: readers see the old rows or the new ones."""
    spark = rows.sparkSession
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fresh, target = f"{path}.new-{uuid.uuid4().hex}", of(path)
    rows.write.json(fresh)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        system.delete(target, True)
    if not system.rename(of(fresh), target):
        raise OSError(f"{path} could not be replaced")


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """With a header: the columns given, or all in sorted order."""
    rows.select(*(columns or sorted(rows.columns))).write.mode("overwrite").option("header", True).csv(path)


def union_of_keys(rows: DataFrame, fields: str) -> DataFrame:
    """A column for each key that any row's map ``fields`` has, in sorted order; null where a row lacks it."""
    keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys(fields))).distinct().collect())  # as many as the table has columns
    return rows.select(*(F.try_element_at(fields, F.lit(k)).alias(k) for k in keys))


def mock_answer(body: Column, keys: Column) -> tuple[Column, Column]:
    """(status, choice) of the offline source: both follow from the body's hash."""
    n = F.conv(F.substring(F.sha2(body, 256), 1, 8), 16, 10).cast("long")
    status = F.when(n % 100 < 3, 429).when(n % 100 < 5, 503).otherwise(200)
    return status, F.when(status == 200, F.element_at(keys, (n % F.size(keys) + 1).cast("int")))
