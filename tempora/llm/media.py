"""Media columns: payloads kept as grey 8-bit PNG members of archives, and read back by byte ranges through a Spark data source.

Each task writes its rows' media one after another into archives in the shared folder, ended by a directory of fixed-size
entries (id, offset, size, checksum) and a footer that says where it is. What tasks finished is a manifest table, so files of
lost attempts are never read. The data source plans partitions as byte ranges of the archives; a task takes the members that
begin in its range, streams them in Arrow batches, and reads a member whose bytes fail their checksum again by its own offset.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tempora.llm.common import documents, drop_path, identified, new_path, slices

#: Payloads are filled up with FILL to a positive multiple of ROW samples, which is the width of an image.
ROW = 576
FILL = 255
#: An archive is closed at this size; a partition of the source covers this many bytes of one.
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 2 << 20
ATTEMPTS = 3

_ENTRY = struct.Struct("<qB3xQII")
_ENTRIES = np.dtype([("id", "<i8"), ("known", "u1"), ("pad", "V3"), ("offset", "<u8"), ("size", "<u4"), ("crc", "<u4")])
_FOOTER = struct.Struct("<8sQQ")
_MAGIC = b"members1"
_PNG = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> bytes:
    """The text in UTF-8, filled up; null counts as empty."""
    data = (text or "").encode("utf-8")
    return data + bytes([FILL]) * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes, width: int = ROW) -> bytes:
    """A grey 8-bit image with these samples, unfiltered."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of a grey 8-bit image without interlace, whatever its filters."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, parts, width = 8, [], 0
    while at < len(image):
        (size,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        data = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            width, _, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", data)
            if (depth, color, interlaced) != (8, 0, 0):
                raise ValueError("not a grey 8-bit image")
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
    if not lines[:, 0].any():
        return lines[:, 1:].tobytes()
    out = np.zeros((len(lines) + 1, width + 1), np.int64)  # a row above and a column to the left of zeros
    for y, (kind, *line) in enumerate(lines.tolist(), 1):
        for x, value in enumerate(line, 1):
            left, above, corner = int(out[y, x - 1]), int(out[y - 1, x]), int(out[y - 1, x - 1])
            if kind == 4:
                p = left + above - corner
                near = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
            else:
                near = (0, left, above, (left + above) // 2)[kind]
            out[y, x] = (value + near) & 255
    return out[1:, 1:].astype(np.uint8).tobytes()


def feature(data: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step from one to the next."""
    counts = np.bincount(samples := np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float(counts @ values) / len(samples)
    deviation = max(0.0, float(counts @ (values * values)) / len(samples) - mean * mean) ** 0.5
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};step={step:.4f}"


class ArchiveWriter:
    """Members one after another, then their directory."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder)
        self.out, self.done = None, []

    def add(self, key: int | None, data: bytes) -> None:
        if self.out is None:
            self.name, self.entries, self.offset = f"{uuid.uuid4().hex}.members", [], 0
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}")
        self.out.write(data)
        self.entries.append(_ENTRY.pack(key or 0, key is not None, self.offset, len(data), zlib.crc32(data)))
        self.offset += len(data)
        if self.offset >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"".join(self.entries))
            self.out.write(_FOOTER.pack(_MAGIC, self.offset, len(self.entries)))
            self.out.close()
            self.done.append((self.name, self.offset, len(self.entries)))
            self.out = None


def write_archives(docs: DataFrame, path: str | None = None) -> str:
    """Stores every row's payload as a member; returns the folder, which holds the members and the manifest of what was finished.

    Null and empty texts are a payload of fill alone; repeated rows and rows without a doc_id are members each; a very long text is
    one member, and may make its archive larger than ARCHIVE_BYTES. Only doc_id and text are read, so other columns may have any
    name. An empty table makes a folder without archives.
    """
    folder = path or new_path(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(f"{folder}/members")
        for batch in batches:
            for part in slices(batch):
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    writer.add(key, to_png(payload(text)))
        writer.close()
        columns = list(zip(*writer.done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["name", "bytes", "members"])

    identified(docs).mapInArrow(run, "name string, bytes long, members long").write.parquet(f"{folder}/manifest")
    return folder


@dataclass
class ByteRange(InputPartition):
    name: str
    start: int
    stop: int


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.span = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the archives; their directories are left to the tasks."""
        files, folder = fs.FileSystem.from_uri(f"{self.folder}/manifest")
        parts = [i.path for i in files.get_file_info(fs.FileSelector(folder)) if i.path.endswith(".parquet")]
        found = [r for p in sorted(parts) for r in pq.read_table(p, filesystem=files, columns=["name", "bytes"], partitioning=None).to_pylist()]
        return [ByteRange(r["name"], a, min(a + self.span, r["bytes"])) for r in found for a in range(0, r["bytes"], self.span)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, folder = fs.FileSystem.from_uri(f"{self.folder}/members")
        members = Members(files, f"{folder}/{partition.name}")
        keys, held, size = [], [], 0
        for entry in members.beginning_in(partition.start, partition.stop):
            keys.append(int(entry["id"]) if entry["known"] else None)
            held.append(members.member(entry))
            size += len(held[-1])
            if size >= BATCH_BYTES:
                yield self.batch(keys, held)
                keys, held, size = [], [], 0
        if held:
            yield self.batch(keys, held)

    @staticmethod
    def batch(keys: list[int | None], held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "media"])


class Members:
    """One archive, opened anew whenever a read has failed."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.files, self.path, self.file = files, path, None

    def at(self, offset: int, size: int) -> bytes:
        if self.file is None:
            self.file = self.files.open_input_file(self.path)
        self.file.seek(offset)
        return self.file.read(size)

    def tried(self, read):
        """Calls read up to ATTEMPTS times, each failure with a new handle."""
        for attempt in range(ATTEMPTS):
            try:
                return read()
            except (OSError, ValueError):
                self.file = None
                if attempt == ATTEMPTS - 1:
                    raise

    def beginning_in(self, start: int, stop: int) -> np.ndarray:
        """The directory entries of members whose first byte is in the range."""

        def read() -> np.ndarray:
            end = self.files.get_file_info(self.path).size - _FOOTER.size
            magic, offset, members = _FOOTER.unpack(self.at(end, _FOOTER.size))
            if magic != _MAGIC or offset + members * _ENTRY.size != end:
                raise ValueError(f"{self.path} has no directory")
            return np.frombuffer(self.at(offset, members * _ENTRY.size), _ENTRIES)

        entries = self.tried(read)
        first, last = np.searchsorted(entries["offset"], [start, stop])
        return entries[first:last]

    def member(self, entry: np.void) -> bytes:
        def read() -> bytes:
            data = self.at(int(entry["offset"]), int(entry["size"]))
            if zlib.crc32(data) != entry["crc"]:
                raise ValueError(f"the member at {entry['offset']} of {self.path} fails its checksum")
            return data

        return self.tried(read)


class MemberSource(DataSource):
    """format("media_members") with option path, a folder of write_archives: doc_id and media of each member."""

    @classmethod
    def name(cls) -> str:
        return "media_members"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


def read_media(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id and media of each member of a folder of write_archives, in no order; equal members are rows each, and a folder without archives gives none.

    A member that fails its checksum ATTEMPTS times raises. range_bytes: how much of an archive a partition covers.
    """
    spark.dataSource.register(MemberSource)
    return spark.read.format("media_members").option("path", folder).option("range_bytes", str(range_bytes)).load()


def inspect(media: DataFrame) -> DataFrame:
    """doc_id, media, payload, n_bytes (without the fill, which no UTF-8 text holds) and feature of each stored medium.

    Media that aren't grey 8-bit images raise; equal media have equal values. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                data = [from_png(m) for m in part.column("media").to_pylist()]
                columns = [pa.array(data, pa.binary()), pa.array([len(d.rstrip(bytes([FILL]))) for d in data], pa.int64()), pa.array([feature(d) for d in data], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("media"), *columns], ["doc_id", "media", "payload", "n_bytes", "feature"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, media binary, payload binary, n_bytes long, feature string")


def drop_archives(spark: SparkSession, folder: str) -> None:
    drop_path(spark, folder)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inspect(read_media(spark, write_archives(documents(spark, sf_dir))))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
