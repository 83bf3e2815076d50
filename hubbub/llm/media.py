"""Operator 9, media columns: payloads as images in zip archives, read by a Spark data source.

A payload (bytes, zero-padded to a multiple of 64) is stored without loss as the 8-bit
samples of a grey PNG 64 wide; a text chunk keeps the unpadded length. Tasks append images
to zip archives of bounded size. The source `media_archive` lists an archive folder, plans
byte ranges of its archives as partitions, and streams the members whose header lies in a
range as Arrow batches of bounded bytes; each member is read by its own offset and retried
alone.

Rows: a null or empty text has one block of 64 zero bytes; equal texts have equal media;
rows that repeat a doc_id are members of their own; a null doc_id comes back as null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_path, table, utf8
from .files import filesystem, list_files, write_file

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
TRIES = 3


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(data: bytes) -> bytes:
    """A grey 8-bit PNG of the padded data, one unfiltered row for every 64 bytes."""
    rows = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    scan = np.zeros((len(rows), WIDTH + 1), np.uint8)
    scan[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> tuple[bytes, int]:
    """The padded payload and the unpadded length; raises ValueError on damage."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, length, data = 8, 0, 0, 0, []
    while at < len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            length = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    scan = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if scan[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return scan[:, 1:].tobytes(), length


def feature(payload: bytes) -> str:
    """Samples, mean, deviation and mean step of the 8-bit samples, in whole numbers and thousandths."""
    x = np.frombuffer(payload, np.uint8)
    step = np.abs(x[1:].astype(np.int16) - x[:-1]).sum()
    total = int(x.sum(dtype=np.int64))
    square = int(np.dot(x.astype(np.int64), x.astype(np.int64)))
    n = len(x)
    return f"{n}:{1000 * total // n}:{1000 * (n * square - total * total) // (n * n)}:{1000 * int(step) // n}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write every text as a member of a zip archive under folder; returns the number of members.

    A task holds one archive of about archive_bytes at a time; a repeated task writes the
    same names again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, n, members, buffer, archive = TaskContext.get().partitionId(), 0, 0, 0, None, None

        def close() -> None:
            nonlocal archive, seq
            archive.close()
            write_file(f"{folder}/media-{task:06d}-{seq:05d}.zip", buffer.getvalue())
            archive, seq = None, seq + 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    buffer, n = io.BytesIO(), 0
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                image = to_image(utf8(text.as_py()))
                archive.writestr(zipfile.ZipInfo(f"{members}_{'' if doc_id.as_py() is None else doc_id.as_py()}.png"), image)
                members, n = members + 1, n + len(image)
                if n >= archive_bytes:
                    close()
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([members])], names=["members"])

    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    return rows.mapInArrow(write, "members long").agg(F.sum("members")).first()[0] or 0


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class MediaArchive(DataSource):
    """format("media_archive").load(folder): archive, offset, name, doc_id, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, doc_id long, media binary"

    def reader(self, schema) -> "MediaReader":
        return MediaReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[ByteRange]:
        """Ranges of at most range_bytes; only names and sizes are looked at here."""
        return [ByteRange(path, k, k + self.range_bytes) for path, size in list_files(self.folder, ".zip") for k in range(0, size, self.range_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ByteRange):  # a folder without archives has no ranges
            return
        system, name = filesystem(partition.path)
        with system.open_input_file(name) as data:  # one handle for the directory and all members of the range
            with zipfile.ZipFile(data) as archive:
                own = [i for i in archive.infolist() if partition.start <= i.header_offset < partition.stop]
            rows, held = [], 0
            for info in own:
                rows.append((partition.path, info.header_offset, info.filename, _doc_id(info.filename), read_member(partition.path, info, data=data)))
                held += len(rows[-1][4])
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _doc_id(name: str) -> int | None:
    text = name.rsplit("/", 1)[-1].removesuffix(".png").split("_", 1)[-1]
    return int(text) if text else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "name", "doc_id", "media"])


def _member(data, path: str, info: zipfile.ZipInfo) -> bytes:
    data.seek(info.header_offset)
    head = data.read(30)
    if head[:4] != b"PK\x03\x04":
        raise OSError(f"no member at {info.header_offset} of {path}")
    n, extra = struct.unpack_from("<HH", head, 26)
    data.seek(info.header_offset + 30 + n + extra)
    body = data.read(info.compress_size)
    if len(body) != info.file_size or zlib.crc32(body) != info.CRC:
        raise OSError(f"damaged member {info.filename} of {path}")
    return body


def read_member(path: str, info: zipfile.ZipInfo, tries: int = TRIES, data=None) -> bytes:
    """One stored member from its offset, from an open file if one is given; a short read, a wrong checksum or an I/O error is tried again, alone and by a file opened anew."""
    for left in range(tries - 1, -1, -1):
        try:
            if data is not None:
                return _member(data, path, info)
            system, name = filesystem(path)
            with system.open_input_file(name) as fresh:
                return _member(fresh, path, info)
        except OSError:
            if not left:
                raise
            data = None
            time.sleep(0.1)
    raise AssertionError


def digests(media: DataFrame) -> DataFrame:
    """Checksums and the feature of each member of a media column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for image in batch.column(1):
                image = image.as_py()
                payload, length = from_image(image)
                for c, v in zip(cols, (length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "media")
    write_archives(table(spark, sf_dir, "documents"), folder)
    spark.dataSource.register(MediaArchive)
    return digests(spark.read.format("media_archive").load(folder))
