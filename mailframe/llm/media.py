"""Media columns: payloads kept as lossless images in archives, read back by a Spark data source.

An archive directory holds *.marc files (members back to back) and, beside each, a *.midx file of
fixed-width records (id, flags, offset, length, crc). The source plans partitions as byte ranges over the
committed archives, opens a range once, streams members as Arrow batches, and retries a member by its own
offset when a read fails or its checksum is wrong. Writers name files after the task attempt; only files
that a commit record lists are read, so lost or repeated attempts leave nothing in the result. Each write has a
record of its own, named after the write, so writes to one directory, at the same time too, add up; one in mode
overwrite takes away the records that were there before it.

A member is an 8-bit greyscale PNG, 576 samples wide: the payload is the text's UTF-8 bytes, padded with 255
to a positive multiple of 576.

Defined cases: null text is empty (one row of padding); a null id is kept as null; repeated rows are members
of their own; an empty table gives an empty archive directory with a commit record, a directory without any record
is not an archive directory (reading it raises); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

WIDTH = 576
RECORD = struct.Struct("<qQIIII")  # id, offset, length, unpadded bytes, crc of the member, 1 if the id is null
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the width."""
    short = -len(payload) % WIDTH if payload else WIDTH
    return payload + b"\xff" * short


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG of rows of WIDTH samples, each row with filter type 0."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of such an image, all checksums verified."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, idat, height, width = 8, [], 0, 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("PNG checksum")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("only filter type 0 is written here")
    return raw[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a 16-bin histogram of the samples, as text."""
    a = np.frombuffer(samples, np.uint8)
    bins = np.bincount(a >> 4, minlength=16)
    total = int(a.sum(dtype=np.int64))
    square = int((a.astype(np.int64) ** 2).sum())
    var = (square * len(a) - total * total) / (len(a) * len(a))
    return f"{len(a) // WIDTH}x{WIDTH};mean={total / len(a):.4f};sd={var**0.5:.4f};hist=" + ",".join(map(str, bins.tolist()))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def _records(fs: pafs.FileSystem, root: str) -> list[str]:
    """The commit records of a directory, by name."""
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("_commit-") and f.base_name.endswith(".json"))


@dataclass
class Written(WriterCommitMessage):
    archive: str
    members: int
    bytes: int


@dataclass
class ByteRange(InputPartition):
    archive: str
    first: int
    count: int


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int, overwrite: bool = False):
        self.path, self.level, self.overwrite, self.name = path, level, overwrite, f"_commit-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name, offset, members = f"part-{uuid.uuid4().hex}", 0, 0
        with fs.open_output_stream(f"{root}/{name}.marc") as data, fs.open_output_stream(f"{root}/{name}.midx") as index:
            for batch in iterator:
                for id_, text in zip(batch["id"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                    body = text or b""
                    image = encode_png(pad(body), self.level)
                    data.write(image)
                    index.write(RECORD.pack(id_ or 0, offset, len(image), len(body), zlib.crc32(image), int(id_ is None)))
                    offset += len(image)
                    members += 1
        return Written(name, members, offset)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        before = _records(fs, root)
        listed = [{"archive": m.archive, "members": m.members, "bytes": m.bytes} for m in messages if m and m.members]
        with fs.open_output_stream(f"{root}/{self.name}.tmp") as f:
            f.write(json.dumps(listed).encode())
        fs.move(f"{root}/{self.name}.tmp", f"{root}/{self.name}.json")
        for path in before if self.overwrite else []:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for m in filter(None, messages):
            for end in ("marc", "midx"):
                fs.delete_file(f"{root}/{m.archive}.{end}")


class MediaReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, retries: int, batch_bytes: int):
        self.path, self.range_bytes, self.retries, self.batch_bytes = path, range_bytes, retries, batch_bytes

    def partitions(self) -> list[ByteRange]:
        """Byte ranges from the commit records alone: a member belongs to the range that its start is in."""
        fs, root = _open(self.path)
        listed = []
        if not (records := _records(fs, root)):
            raise FileNotFoundError(f"no commit record in {self.path}")
        for path in records:
            with fs.open_input_stream(path) as f:
                listed += json.loads(f.read())
        ranges = [ByteRange(x["archive"], at, min(self.range_bytes, x["bytes"] - at)) for x in listed for at in range(0, x["bytes"], self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def _member(self, f, offset: int, length: int, crc: int) -> tuple[bytes | None, int]:
        """The member's bytes, or None once every try failed; each try seeks to the member's own offset."""
        for tried in range(self.retries + 1):
            try:
                f.seek(offset)
                data = f.read(length)
            except OSError:
                continue
            if len(data) == length and zlib.crc32(data) == crc:
                return data, tried
        return None, self.retries

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, root = _open(self.path)
        with fs.open_input_stream(f"{root}/{part.archive}.midx") as f:
            index = np.frombuffer(f.read(), np.dtype([("id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n", "<u4"), ("crc", "<u4"), ("null", "<u4")]))
        lo, hi = np.searchsorted(index["offset"], [part.first, part.first + part.count])
        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("retries", pa.int32()), ("archive", pa.string()), ("offset", pa.int64())])
        rows, size = [], 0
        with fs.open_input_file(f"{root}/{part.archive}.marc") as f:
            for m in index[lo:hi]:
                data, tried = self._member(f, int(m["offset"]), int(m["length"]), int(m["crc"]))
                rows.append((None if m["null"] else int(m["id"]), int(m["n"]), data, tried, part.archive, int(m["offset"])))
                size += int(m["length"])
                if size >= self.batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").option("path", directory); the same format writes (id, payload) rows."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id long, n_bytes long, media binary, retries int, archive string, offset long"

    def reader(self, schema) -> MediaReader:
        o = self.options
        return MediaReader(o["path"], int(o.get("rangeBytes", 16 << 20)), int(o.get("retries", 3)), int(o.get("batchBytes", 4 << 20)))

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options["path"], int(self.options.get("level", 1)), overwrite)


def write_media(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store (id, payload) rows as members of archives at path, beside those there or (mode overwrite) in their place."""
    df.sparkSession.dataSource.register(MediaArchive)
    df.select("id", "payload").write.format("media_archive").mode(mode).option("path", path).save()


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(path=path, **{k: str(v) for k, v in options.items()}).load()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Decode members and compute digests and features; a member that no retry could read fails the task."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for b in batches:
            rows = []
            for id_, n, data, where, at in zip(*(b[k].to_pylist() for k in ("id", "n_bytes", "media", "archive", "offset")), strict=True):
                if data is None:
                    raise OSError(f"member at {at} of {where} can't be read")
                samples = decode_png(data)
                rows.append((id_, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return media.mapInArrow(run, FEATURES)
