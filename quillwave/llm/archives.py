"""Archives of media members: a writer for tasks and a Spark data source that reads by byte range and offset.

An archive is a ZIP file whose member names all have one length, so every entry of its central directory has one
size and a slice of the directory is a range of bytes.  Archives roll at `ROLL_BYTES`, which keeps them under the
4 GB of plain ZIP; a single larger member is refused.  A folder's `_archives.json` lists the finished archives;
files of failed attempts are not in it.

The data source `media_archive` (option `path`) plans partitions as byte ranges of the archives' directories.  A
task reads its range, then its members' bytes in long runs, and streams them as Arrow batches of bounded size.
A member whose bytes can't be read or don't fit its checksum is read again on its own, by its offset.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROLL_BYTES = 256 << 20
PARTITION_BYTES = 16 << 20
RUN_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
TRIES = 3
NAME = "{id:>21}-{seq:010d}.wav"
NAME_BYTES = 36
_LOCAL = struct.Struct("<IHHHHHIIIHH")
_ENTRY = struct.Struct("<IHHHHHHIIIHHHHHII")
_END = struct.Struct("<IHHHHIIH")
ENTRY_BYTES = _ENTRY.size + NAME_BYTES
INDEX = "_archives.json"
SCHEMA = "doc_id long, name string, media binary"


class DamagedMember(IOError):
    """A member can't be read back after all tries."""


class ArchiveWriter:
    """Members into rolling archives of one task; names are of the attempt's own."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.made: list[dict] = []
        self.stream = None

    def add(self, doc_id: int | None, media: bytes) -> None:
        if self.stream is None:
            self.fs.create_dir(self.root, recursive=True)
            self.name = f"{uuid.uuid4().hex}.zip"
            self.stream, self.at, self.entries = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0, []
        name = NAME.format(id="null" if doc_id is None else doc_id, seq=len(self.entries)).encode()
        packer = zlib.compressobj(1, zlib.DEFLATED, -15)
        packed = packer.compress(media) + packer.flush()
        if len(media) >= 1 << 31 or len(name) != NAME_BYTES:
            raise ValueError("member too large for an archive")
        crc = zlib.crc32(media)
        common = (20, 0x800, 8, 0, 0x21, crc, len(packed), len(media), NAME_BYTES, 0)
        self.stream.write(_LOCAL.pack(0x04034B50, *common) + name)
        self.stream.write(packed)
        self.entries.append(_ENTRY.pack(0x02014B50, 20, *common, 0, 0, 0, 0, self.at) + name)
        self.at += _LOCAL.size + NAME_BYTES + len(packed)
        if self.at >= ROLL_BYTES or len(self.entries) == 65_000:
            self.close()

    def close(self) -> None:
        if self.stream is None:
            return
        directory = b"".join(self.entries)
        self.stream.write(directory + _END.pack(0x06054B50, 0, 0, len(self.entries), len(self.entries), len(directory), self.at, 0))
        self.stream.close()
        self.made.append({"file": self.name, "members": len(self.entries), "directory": self.at})
        self.stream = None


def write_index(folder: str, archives: list[dict]) -> None:
    """Publish the finished archives of a folder: one small record each."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{INDEX}") as out:
        out.write(json.dumps(sorted(archives, key=lambda a: a["file"])).encode())


class DirectoryRange(InputPartition):
    """A byte range of an archive's directory."""

    def __init__(self, file: str, start: int, stop: int):
        super().__init__((file, start, stop))
        self.file, self.start, self.stop = file, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[DirectoryRange]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_stream(f"{root}/{INDEX}") as source:
            archives = json.loads(source.read())
        out = []
        for a in archives:
            parts = max(1, min(a["members"], -(-a["directory"] // PARTITION_BYTES)))
            cuts = [a["members"] * i // parts for i in range(parts + 1)]
            out += [DirectoryRange(a["file"], a["directory"] + lo * ENTRY_BYTES, a["directory"] + hi * ENTRY_BYTES) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        return out or [DirectoryRange("", 0, 0)]

    def read(self, partition: DirectoryRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, root = pafs.FileSystem.from_uri(self.folder)
        path = f"{root}/{partition.file}"
        with fs.open_input_file(path) as source:
            raw = source.read_at(partition.stop - partition.start, partition.start)
            members = [entry_of(raw[at : at + ENTRY_BYTES]) for at in range(0, len(raw), ENTRY_BYTES)]
            rows, size = [], 0
            for member, media in read_members(source, members, lambda: fs.open_input_file(path)):
                rows.append((member["doc_id"], member["name"], media))
                size += len(media)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "name", "media"])


def entry_of(raw: bytes) -> dict:
    sig, _, _, _, method, _, _, crc, packed, size, *_, offset = _ENTRY.unpack_from(raw)
    if sig != 0x02014B50 or method != 8:
        raise DamagedMember("not a directory entry")
    name = raw[_ENTRY.size :].decode()
    doc_id = name.rpartition("-")[0].strip()
    return {"name": name, "doc_id": None if doc_id == "null" else int(doc_id), "crc": crc, "packed": packed, "size": size, "offset": offset}


def _unpacked(member: dict, raw: bytes) -> bytes:
    body = raw[_LOCAL.size + NAME_BYTES :]
    try:
        media = zlib.decompress(body, -15)
    except zlib.error as e:
        raise DamagedMember(member["name"]) from e
    if len(media) != member["size"] or zlib.crc32(media) != member["crc"]:
        raise DamagedMember(member["name"])
    return media


def read_members(source, members: list[dict], reopen) -> Iterator[tuple[dict, bytes]]:
    """Members in order, read in runs; one that fails is read again alone, from a newly opened file."""
    extent = lambda m: _LOCAL.size + NAME_BYTES + m["packed"]
    lo = 0
    while lo < len(members):
        hi, size = lo, 0
        while hi < len(members) and (hi == lo or size + extent(members[hi]) <= RUN_BYTES):
            size += extent(members[hi])
            hi += 1
        base = members[lo]["offset"]
        try:
            run = source.read_at(size, base)
        except OSError:
            run = b""
        for m in members[lo:hi]:
            at = m["offset"] - base
            try:
                yield m, _unpacked(m, run[at : at + extent(m)])
            except DamagedMember:
                yield m, _again(m, extent(m), reopen)
        lo = hi


def _again(member: dict, size: int, reopen) -> bytes:
    for left in range(TRIES - 1, -1, -1):
        try:
            with reopen() as source:
                return _unpacked(member, source.read_at(size, member["offset"]))
        except OSError:
            if not left:
                raise
    raise DamagedMember(member["name"])


class MediaArchiveSource(DataSource):
    """`spark.read.format("media_archive").option("path", folder)`."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])
