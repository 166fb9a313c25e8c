"""Append-only journals of JSON lines as a data source of Spark's own kind.

    spark.dataSource.register(Journal)
    df.write.format("journal").mode("append").save(folder)
    spark.read.format("journal").load(folder)

Writing. Every task writes a part of its own under a name that no reader looks at, and
flushes it to disk every two seconds and at its end. The commit, on the driver, first
gives all parts their names and then writes one line to the journal's log, naming
them with their lengths, lines and checksums; a part that no whole line of the log names
doesn't exist for readers. So a writer that is killed leaves nothing torn: its parts are
unnamed, or its log line lacks its end. The next commit cuts a torn line off the log
before it appends, and ``repair`` takes away parts that no line names.

Reading. A row for each line of each named part that isn't blank: file, line_no (from 1),
text, problem: null, "not json" or "not an object". Parts shorter than the log
says, or of another checksum, give one row with problem "damaged part", and no lines.
Large parts are read line by line.

The folder is one that driver and executors share, reached by a path or a URI that
``pyarrow.fs`` knows; appends of one journal are made one after another. An empty
table commits a line without parts. A missing folder has no rows.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

LINES = "file string, line_no long, text string, problem string"
LOG, FLUSH_SECONDS = "_journal.log", 2.0


def _system(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def _read(system: pafs.FileSystem, path: str) -> bytes:
    if system.get_file_info(path).type != pafs.FileType.File:
        return b""
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def committed(folder: str) -> list[dict]:
    """The parts that whole lines of the log name, in order."""
    system, base = _system(folder)
    data = _read(system, f"{base}/{LOG}")
    whole = data[: data.rfind(b"\n") + 1]
    return [part for line in whole.splitlines() if line for part in json.loads(line)["parts"]]


def repair(folder: str) -> list[str]:
    """Cuts a torn line off the log and removes parts that it doesn't name; their names."""
    system, base = _system(folder)
    data = _read(system, f"{base}/{LOG}")
    whole = data[: data.rfind(b"\n") + 1]
    if whole != data:
        _replace(system, f"{base}/{LOG}", whole)
    named = {part["file"] for part in committed(folder)}
    found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    stray = sorted(f.base_name for f in found if f.type == pafs.FileType.File and f.base_name != LOG and f.base_name not in named)
    for name in stray:
        system.delete_file(f"{base}/{name}")
    return stray


def _replace(system: pafs.FileSystem, path: str, data: bytes) -> None:
    """A file's content, whole or not at all: written beside it and renamed over it."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside, compression=None) as f:
        f.write(data)
    if not isinstance(system, pafs.LocalFileSystem) and system.get_file_info(path).type == pafs.FileType.File:
        system.delete_file(path)  # stores that don't rename over a file
    system.move(beside, path)


@dataclass
class Part(WriterCommitMessage):
    file: str
    temporary: str
    size: int
    lines: int
    sha256: str


@dataclass
class OfPart(InputPartition):
    file: str
    size: int
    sha256: str


class JournalReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[OfPart]:
        return [OfPart(p["file"], p["size"], p["sha256"]) for p in committed(self.folder)] or [OfPart("", 0, "")]

    def read(self, partition: OfPart) -> Iterator[tuple]:
        if not partition.file:
            return
        system, base = _system(self.folder)
        path = f"{base}/{partition.file}"
        if not self._sound(system, path, partition):
            yield (partition.file, None, None, "damaged part")
            return
        with system.open_input_stream(path, compression=None) as f:
            rest, number = b"", 0
            while True:
                block = f.read(1 << 20)
                *lines, rest = (rest + block).split(b"\n") if block else [rest, b""]
                for line in lines:
                    number += 1
                    if text := line.decode("utf-8", "replace").strip():
                        yield (partition.file, number, text, _problem(text))
                if not block:
                    return

    def _sound(self, system: pafs.FileSystem, path: str, partition: OfPart) -> bool:
        if system.get_file_info(path).size != partition.size:
            return False
        digest = hashlib.sha256()
        with system.open_input_stream(path, compression=None) as f:
            while block := f.read(1 << 20):
                digest.update(block)
        return digest.hexdigest() == partition.sha256


def _problem(text: str) -> str | None:
    try:
        return None if isinstance(json.loads(text), dict) else "not an object"
    except ValueError:
        return "not json"


class JournalWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Part:
        system, base = _system(self.folder)
        system.create_dir(base, recursive=True)
        name = f"part-{self.run}-{uuid.uuid4().hex}.jsonl"
        digest, size, lines, flushed = hashlib.sha256(), 0, 0, time.monotonic()
        with system.open_output_stream(f"{base}/_{name}", compression=None) as f:
            for row in iterator:
                data = (row["text"] or "").replace("\r", "").replace("\n", " ").encode("utf-8", "replace") + b"\n"
                f.write(data)
                digest.update(data)
                size, lines = size + len(data), lines + 1
                if time.monotonic() - flushed >= FLUSH_SECONDS:
                    f.flush()
                    flushed = time.monotonic()
        return Part(name, f"_{name}", size, lines, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        system, base = _system(self.folder)
        system.create_dir(base, recursive=True)
        parts = [m for m in messages if m is not None]
        kept = [p for p in parts if p.lines]
        for p in parts:
            system.move(f"{base}/{p.temporary}", f"{base}/{p.file}") if p.lines else system.delete_file(f"{base}/{p.temporary}")
        data = _read(system, f"{base}/{LOG}")
        whole = data[: data.rfind(b"\n") + 1]  # what a killed commit left behind its last whole line goes
        line = json.dumps({"run": self.run, "parts": [{"file": p.file, "size": p.size, "lines": p.lines, "sha256": p.sha256} for p in kept]}, separators=(",", ":"))
        _replace(system, f"{base}/{LOG}", whole + line.encode() + b"\n")

    def abort(self, messages: list[Part | None]) -> None:
        system, base = _system(self.folder)
        for p in messages:
            if p is not None and system.get_file_info(f"{base}/{p.temporary}").type == pafs.FileType.File:
                system.delete_file(f"{base}/{p.temporary}")


class Journal(DataSource):
    """``text`` is the column that is written, a JSON text a row; LINES is what is read."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> JournalReader:
        return JournalReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> JournalWriter:
        if overwrite:
            raise ValueError("a journal is only appended to")
        return JournalWriter(self.options["path"])
