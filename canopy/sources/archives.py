"""A Spark data source over the segment archives of a store.

One partition per archive; the driver only lists files and reads the archives'
last blocks to choose among them.  Executors map each file and hand its
segments on, so the store's directory must be one that they share.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from canopy.schema import FormatError

#: Fixed values of the archive format.
BLOCK, FOOTER, END = 512, 16, 1024
INDEX_MAGIC = {0x0A304B0A: (1, 28), 0x0A314B0A: (2, 33)}
GRAPH_MAGIC = 0x0A30470A
BINARIES_MAGIC = {0x0A30420A: 1, 0x0A31420A: 2}
SEGMENT_MAGIC, COMPACTED_BIT = b"0aK", 1 << 31

NAME = re.compile(r"data(\d{5,})([a-z])?\.tar")
ENTRY_NAME = re.compile(r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})(?:\.([0-9a-f]{8}))?(?:\..*)?")

SCHEMAS = {
    "archives": "file_name string, archive_number bigint, letter string, bytes bigint, index_version int, recovery_reason string",
    "segments": "segment string, kind string, archive string, archive_number bigint, position bigint, size bigint, generation int, full_generation int, is_compacted boolean, content binary",
    "references": "archive string, source string, target string",
    "binary_references": "archive string, generation int, full_generation int, is_compacted boolean, segment string, blob_id string",
}


@dataclass(frozen=True)
class Entry:
    segment: str
    position: int
    size: int
    generation: int
    full_generation: int
    is_compacted: bool


@dataclass
class Archive:
    """What an archive's blocks say: its entries, the version of its index, or why it was scanned instead."""

    entries: list[Entry]
    version: int | None
    reason: str | None
    trailers_end: int


def _identifier(raw: bytes) -> str:
    return str(uuid.UUID(bytes=raw))


def kind_of(segment: str) -> str:
    return {"a": "data", "b": "bulk"}.get(segment[19], "other")


def _signed(raw: bytes) -> tuple[int, int]:
    return struct.unpack(">qq", raw)


def read_index(data) -> tuple[int, list[Entry], int]:
    """Version, entries and where the trailers before the index end; FormatError for an invalid one."""
    n = len(data)
    if n % BLOCK or n < 6 * BLOCK:
        raise FormatError("not the size of an archive")
    anchor = n - END
    checksum, count, declared, magic = struct.unpack(">IiiI", data[anchor - FOOTER : anchor])
    if magic not in INDEX_MAGIC:
        raise FormatError("no index")
    version, width = INDEX_MAGIC[magic]
    begin = anchor - FOOTER - count * width
    if count < 1 or declared < count * 28 + FOOTER or declared % BLOCK or begin < anchor - declared or anchor - declared < BLOCK:
        raise FormatError("index of a wrong size")
    raw = bytes(data[begin : anchor - FOOTER])
    if zlib.crc32(raw) != checksum:
        raise FormatError("index with a wrong checksum")
    entries, last = [], None
    for k in range(count):
        row = raw[k * width : (k + 1) * width]
        order = _signed(row[:16])
        if last is not None and order <= last:
            raise FormatError("index out of order")
        last = order
        position, size, generation = struct.unpack(">iii", row[16:28])
        full, compacted = (struct.unpack(">i", row[28:32])[0], row[32] != 0) if version == 2 else (generation, True)
        if position < 0 or position % BLOCK or size < 1 or position + size > n:
            raise FormatError("index entry of a wrong place")
        entries.append(Entry(_identifier(row[:16]), position, size, generation, full, compacted))
    return version, entries, anchor - declared - BLOCK


def header_generation(content: bytes) -> tuple[int, int, bool]:
    """Generations that a segment's own header states; bulk segments have none."""
    if content[:3] != SEGMENT_MAGIC:
        return 0, 0, False
    generation = struct.unpack(">i", content[10:14])[0]
    if content[3] == 12:
        return generation, generation, True
    full = struct.unpack(">I", content[4:8])[0]
    return generation, full & (COMPACTED_BIT - 1), bool(full & COMPACTED_BIT)


def scan_entries(data) -> list[Entry]:
    """Entries by walking the tar headers, for an archive without an index: those whose checksum is right, up to where it breaks off."""
    found: dict[str, tuple[int, int]] = {}
    at, n = 0, len(data)
    while at + BLOCK <= n:
        header = bytes(data[at : at + BLOCK])
        at += BLOCK
        name = header[:100].split(b"\0")[0].decode("utf-8", "replace")
        octal = header[124:136].strip(b"\0 ")
        if not name or not re.fullmatch(rb"[0-7]+", octal):
            continue
        size = int(octal, 8)
        if at + size > n:
            break
        padded = -(-size // BLOCK) * BLOCK
        m = ENTRY_NAME.fullmatch(name)
        if m and (m[2] or m[1] not in found):
            if not m[2] or zlib.crc32(data[at : at + size]) == int(m[2], 16):
                found[m[1]] = at, size
        at += padded
    return [Entry(s, p, z, *header_generation(bytes(data[p : p + min(z, 32)]))) for s, (p, z) in found.items()]


def open_archive(path: str) -> tuple[memoryview | mmap.mmap, Archive]:
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    try:
        version, entries, end = read_index(data)
        return data, Archive(entries, version, None, end)
    except FormatError as e:
        return data, Archive(scan_entries(data), None, str(e), 0)


def read_graph(data, end: int) -> list[tuple[str, str]] | None:
    """Edges of the graph trailer that ends at ``end``; None if there is no valid one."""
    if end < FOOTER:
        return None
    checksum, count, size, magic = struct.unpack(">IiiI", data[end - FOOTER : end])
    if magic != GRAPH_MAGIC or count < 0 or size < FOOTER or size > end:
        return None
    raw = bytes(data[end - size : end - FOOTER])
    if zlib.crc32(raw) != checksum:
        return None
    out, at = [], 0
    try:
        for _ in range(count):
            (n,) = struct.unpack(">i", raw[at + 16 : at + 20])
            source = _identifier(raw[at : at + 16])
            at += 20
            for _ in range(n):
                out.append((source, _identifier(raw[at : at + 16])))
                at += 16
    except (struct.error, ValueError):
        return None
    return out


def read_binary_references(data, end: int) -> list[tuple] | None:
    """Rows of the catalogue of external binaries that ends at ``end``; None if there is no valid one."""
    if end < FOOTER:
        return None
    checksum, count, size, magic = struct.unpack(">IiiI", data[end - FOOTER : end])
    if magic not in BINARIES_MAGIC or count < 0 or size < FOOTER or size > end:
        return None
    raw = bytes(data[end - size : end - FOOTER])
    if zlib.crc32(raw) != checksum:
        return None
    out, at = [], 0

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack(">i", raw[at - 4 : at])[0]

    try:
        for _ in range(count):
            generation = number()
            full, compacted = generation, True
            if BINARIES_MAGIC[magic] == 2:
                full, compacted = number(), raw[at] != 0
                at += 1
            for _ in range(number()):
                segment = _identifier(raw[at : at + 16])
                at += 16
                for _ in range(number()):
                    length = number()
                    out.append((generation, full, compacted, segment, raw[at : at + length].decode("utf-8", "replace")))
                    at += length
    except (struct.error, ValueError, IndexError):
        return None
    return out


def trailer_start(data, end: int) -> int:
    """Where the entry whose trailer ends at ``end`` begins, its tar header included."""
    size = struct.unpack(">i", data[end - 8 : end - 4])[0]
    return end + -(-size // BLOCK) * -BLOCK - BLOCK


def select_archives(directory: str) -> list[tuple[str, int, str]]:
    """File, number and letter of the archives that count.

    Of a number's files the one of the highest letter with a valid index; if none
    has one, all of them, to be scanned.  Empty files don't count.
    """
    by_number: dict[int, dict[str, str]] = {}
    for name in sorted(os.listdir(directory)):
        m = NAME.fullmatch(name)
        if not m or not os.path.getsize(os.path.join(directory, name)):
            continue
        letters = by_number.setdefault(int(m[1]), {})
        if (m[2] or "a") in letters:
            raise FormatError(f"two archives {m[1]}{m[2] or 'a'}")
        letters[m[2] or "a"] = name
    out = []
    for number, letters in sorted(by_number.items()):
        for letter in sorted(letters, reverse=True):
            data, archive = open_archive(os.path.join(directory, letters[letter]))
            data.close()
            if archive.version is not None:
                out.append((letters[letter], number, letter))
                break
        else:
            out.extend((letters[x], number, x) for x in sorted(letters, reverse=True))
    return out


class ArchivePartition(InputPartition):
    def __init__(self, name: str, number: int, letter: str) -> None:
        super().__init__((name, number, letter))
        self.name, self.number, self.letter = name, number, letter


class ArchiveReader(DataSourceReader):
    def __init__(self, directory: str, table: str) -> None:
        self.directory, self.table = directory, table

    def partitions(self) -> list[ArchivePartition]:
        return [ArchivePartition(*x) for x in select_archives(self.directory)]

    def read(self, partition: ArchivePartition) -> Iterator[tuple]:
        path = os.path.join(self.directory, partition.name)
        data, archive = open_archive(path)
        if self.table == "archives":
            yield partition.name, partition.number, partition.letter, len(data), archive.version, archive.reason
        elif self.table == "segments":
            for e in archive.entries:
                yield e.segment, kind_of(e.segment), partition.name, partition.number, e.position, e.size, e.generation, e.full_generation, e.is_compacted, bytes(data[e.position : e.position + e.size])
        elif archive.version is not None:
            end = archive.trailers_end
            graph = read_graph(data, end)
            if self.table == "references":
                for edge in graph or []:
                    yield partition.name, *edge
            else:
                for row in read_binary_references(data, trailer_start(data, end) if graph is not None else end) or []:
                    yield partition.name, *row


class ArchiveSource(DataSource):
    """``spark.read.format("canopy-archives").option("table", ...).load(directory)``."""

    @classmethod
    def name(cls) -> str:
        return "canopy-archives"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "segments")]

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("table", "segments"))


def read_archives(spark: SparkSession, directory: str, table: str = "segments") -> DataFrame:
    """A table of the store's archives: ``archives``, ``segments``, ``references`` or ``binary_references``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("canopy-archives").option("table", table).load(directory)


def read_manifest(directory: str) -> int:
    """The store's version, 1 or 2; FormatError for older and newer ones."""
    try:
        with open(os.path.join(directory, "manifest"), encoding="latin-1") as f:
            lines = [x.strip() for x in f]
    except FileNotFoundError:
        raise FormatError("no manifest: the store is older than archives of segments, or none") from None
    found = dict(re.split(r"\s*[=:\s]\s*", x, maxsplit=1) for x in lines if x and x[0] not in "#!" and re.search(r"[=:\s]", x))
    version = found.get("store.version", "")
    if version not in ("1", "2"):
        raise FormatError(f"store version {version or 'missing'}")
    return int(version)
