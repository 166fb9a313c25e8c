"""WARC archives, and a normaliser for monolithic gzip.

``write_monolithic`` writes a record for each page with Spark's own text
writer, one gzip stream a file: the records' closing blank lines are its line
separator. ``normalise`` inflates each such stream once, block by block, and
writes every record as a gzip member of its own, with a table of where each
member lies beside it. ``read_back`` reads members by that table.

A response holds an HTTP head and the payload, the html in UTF-8; a revisit holds
the head alone, which tells the length of the payload that it stands for.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the
smallest page id is the response; the others are revisits, which refer to it
and hold no payload. Smaller payloads are always responses. Digests are
SHA-256.

Null html is an empty payload. Repeated rows of a page are a record each, of
one type: a response or revisits of another page. Rows with a null id are
responses. An empty table gives no archives and no rows. Very large records are
held one at a time. Of other columns than id, url and html none is kept, and
none is in the way.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import fresh, partitions, shared_dir

MIN_REVISIT = 100
#: Bytes that are inflated at once, and records of a file that the writer begins a new one after.
CHUNK, FILE_RECORDS = 1 << 20, 20_000
#: Ways among which the rows of one payload are dealt when they meet its response.
SALTS = 16
#: Fixed value: the date of all records, so that archives are equal for equal pages.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Fixed value: a response's HTTP head up to the length of its payload.
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "


def roles(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """``pages`` as (page_id, url?, payload, digest, refers_to); refers_to is
    null for responses.

    First of each payload: a partial minimum for each task, then one row a
    payload. Only payloads that occur twice are joined with the pages, salted,
    so that a payload that a third of all pages have is no task's alone."""
    payload, digest, salt = fresh(pages, "payload", "digest", "salt")
    rows = pages.withColumn(payload, F.coalesce(F.col(html), F.lit(""))).withColumn(digest, F.sha2(F.col(payload).cast("binary"), 256))
    large = F.octet_length(payload) >= MIN_REVISIT
    groups = rows.where(large).groupBy(digest).agg(F.min(page_id).alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    salted = groups.select(F.col(digest).alias("of"), "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    rows = rows.withColumn(salt, F.when(large, F.pmod(F.xxhash64(page_id), F.lit(SALTS)).cast("int")))
    joined = rows.join(salted, (F.col(digest) == F.col("of")) & (F.col(salt) == F.col("of_salt")), "left")
    return joined.select(F.col(page_id).cast("long").alias("page_id"), (F.col("url") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"),
                         F.col(payload).alias("payload"), F.col(digest).alias("digest"),
                         F.when(F.col(page_id) != F.col("first_id"), F.col("first_id")).cast("long").alias("refers_to"))


def records(rows: DataFrame) -> DataFrame:
    """(value): each record's text without its two closing line ends."""
    size = F.octet_length("payload")
    http = F.concat(F.lit(HTTP), size.cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20]", "%20")
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
                       F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")),
                       F.concat(F.lit("WARC-Target-URI: "), uri), F.lit(f"WARC-Date: {DATE}"),
                       F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), 
                       F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                       F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
                       F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(size)).cast("string")))
    return rows.select(F.concat(head, F.lit(CRLF + CRLF), http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_monolithic(rows: DataFrame, path: str) -> None:
    """WARC files under ``path``, each one gzip stream."""
    records(rows).write.mode("overwrite").option("compression", "gzip").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def inflate_records(stream) -> Iterator[bytes]:
    """The records of a WARC file, whether it is one gzip stream or has many
    members, inflated once; at most CHUNK bytes and one record are held."""
    inflater, held = zlib.decompressobj(31), bytearray()
    at, need = 0, None
    while True:
        block = stream.read(CHUNK)
        if not block and not inflater.unconsumed_tail:
            break
        while block:
            held += inflater.decompress(block, CHUNK)
            block = inflater.unconsumed_tail
            if inflater.eof:
                block, inflater = inflater.unused_data, zlib.decompressobj(31)
            while True:
                if need is None:
                    end = held.find(b"\r\n\r\n", at)
                    if end < 0:
                        break
                    need = end + 4 + int(re.search(rb"(?im)^content-length:\s*(\d+)", held[at:end])[1]) + 4
                if len(held) < need:
                    break
                yield bytes(held[at:need])
                at, need = need, None
                if at > CHUNK:
                    del held[:at]
                    at = 0
            if at:
                del held[:at]
                need = None if need is None else need - at
                at = 0
    if held.strip():
        raise ValueError("a WARC file ends within a record")


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header(record: bytes) -> dict[str, str]:
    head = record[:record.index(b"\r\n\r\n")].decode("utf-8")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split(CRLF)[1:])}


INDEX = "file string, record long, offset long, length long, record_id string, record_type string, digest string, refers_to string"


def _settle(system, part: str, name: str) -> None:
    """Gives a finished file its name. Some file systems refuse a name that is taken: then another
    attempt of the same task has finished, its file has the same bytes, and this one goes."""
    try:
        system.move(part, name)
    except OSError:
        if system.get_file_info(name).type.name != "File":
            raise
        system.delete_file(part)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrites the WARC files under ``source`` to ``target`` with a gzip member
    for each record; writes and returns the table of members (INDEX).

    A file is one task's work. It is written under a name of the attempt's own
    and then moved, so a lost executor leaves no half of a file behind."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    names = names.repartition(max(1, partitions(spark)), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                system, inside = filesystem(path)
                out_system, folder = filesystem(target)
                out_system.create_dir(folder, recursive=True)
                name = re.sub(r"(\.txt)?\.gz$", ".warc.gz", inside.rsplit("/", 1)[1])
                part = f"{folder}/_{uuid.uuid4().hex}"
                rows, offset = [], 0
                with system.open_input_stream(inside, compression=None) as stream, out_system.open_output_stream(part, compression=None) as sink:
                    for number, record in enumerate(inflate_records(stream)):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        sink.write(member)
                        h = header(record)
                        rows.append((name, number, offset, len(member), h.get("warc-record-id"), h.get("warc-type"), h.get("warc-payload-digest"), h.get("warc-refers-to")))
                        offset += len(member)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                            rows = []
                _settle(out_system, part, f"{folder}/{name}")
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])

    names.mapInPandas(run, INDEX).write.mode("overwrite").parquet(f"{target}-index")
    return spark.read.parquet(f"{target}-index")


def read_back(index: DataFrame, target: str) -> DataFrame:
    """(record_id, record_type, payload_bytes, payload_digest, refers_to): each
    member found by the index, inflated and digested. Revisits carry the
    figures of the payload that they stand for."""
    schema = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, sound boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = filesystem(target)
        for pdf in batches:
            out = []
            for name, part in pdf.sort_values(["file", "offset"]).groupby("file", sort=False):
                with system.open_input_file(f"{folder}/{name}") as f:
                    for offset, length in zip(part["offset"], part["length"]):
                        f.seek(int(offset))
                        record = zlib.decompress(f.read(int(length)), 31)
                        h = header(record)
                        content = record[record.index(b"\r\n\r\n") + 4:-4]
                        size, body = int(header(content)["content-length"]), content[content.index(b"\r\n\r\n") + 4:]
                        told, whole = h["warc-payload-digest"].removeprefix("sha256:"), len(content) == int(h["content-length"])
                        if h["warc-type"] == "response":
                            own = hashlib.sha256(body).hexdigest()
                            out.append((h["warc-record-id"], "response", len(body), own, None, whole and own == told and len(body) == size))
                        else:
                            out.append((h["warc-record-id"], h["warc-type"], size, told, h.get("warc-refers-to"), whole and not body))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return index.select("file", "offset", "length").mapInPandas(run, schema)


def op7_warc_normalise(spark, sf_dir):
    """One row per page, read back from the normalised archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_monolithic(roles(pages, "page_id", "html"), f"{folder}/monolithic")
    found = read_back(normalise(spark, f"{folder}/monolithic", f"{folder}/normal"), f"{folder}/normal")
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    sound = F.when(F.col("sound"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", sound.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


#: The digest columns follow from the pages alone.
OP7_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f"""
