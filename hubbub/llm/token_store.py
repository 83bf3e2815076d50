"""Operator 1, token-ID output: shards of patched frame-of-reference blocks.

A shard holds the ids of neighbouring documents in ascending doc_id order:

    b"PFOR" version(u32) n_docs(u64) n_ids(u64) n_blocks(u64)
    doc ids (i64 each, MISSING for null), ids of each document (u64 each)
    starts of the blocks, from the first block on (u64 each)
    blocks

A block holds 1024 ids at most: count(u16) minimum(u32) width(u8) n_exceptions(u16), then
(id - minimum) packed at `width` bits, then the exceptions' positions (u16) and their high
bits (u32). The width is the one that leaves EXCEPT of the ids, or fewer, over it. All
numbers are little-endian. A block decodes by itself: its place is in the index.

Rows: a null text is an empty one and holds the end id only; rows that repeat a doc_id are
documents of their own, ordered by the hash of the text, then the text; a long text runs over
as many blocks as it needs; a null doc_id sorts first and comes back as null;
an empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import chunks, encoder, vocabulary
from .common import new_path, table
from .files import read_file, write_file

END_ID = 2
BLOCK = 1024
PERCENTILE = 95
MISSING = -(2**63)
HEAD = struct.Struct("<4sIQQQ")
BLOCK_HEAD = struct.Struct("<HIBH")


def _pack(offsets: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each, the first in the lowest bits; whole bytes need no bit work."""
    if width in (8, 16, 32):
        return offsets.astype(f"<u{width // 8}").tobytes()
    bits = (offsets[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n, at).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (n * width + 7) // 8, at), count=n * width, bitorder="little")
    return bits.reshape(n, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block: offsets from the minimum, packed at the width that `percentile` of them fit in."""
    low = int(ids.min())
    offsets = (ids - low).astype(np.uint32)
    k = min(len(offsets) - 1, int(len(offsets) * percentile / 100))
    width = int(np.partition(offsets, k)[k]).bit_length()
    over = np.flatnonzero(offsets >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    high = (offsets[over] >> np.uint32(width % 32)).astype("<u4")
    return BLOCK_HEAD.pack(len(ids), low, width, len(over)) + _pack(offsets, width) + over.astype("<u2").tobytes() + high.tobytes()


def decode_block(data: bytes, at: int = 0) -> np.ndarray:
    n, low, width, n_over = BLOCK_HEAD.unpack_from(data, at)
    at += BLOCK_HEAD.size
    n_bytes = (n * width + 7) // 8
    ids = _unpack(data, at, n, width)
    at += n_bytes
    over = np.frombuffer(data, "<u2", n_over, at)
    high = np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
    ids[over] |= high << np.uint32(width)
    return ids + np.uint32(low)


def encode_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = [encode_block(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)], dtype="<u8")[:-1]
    head = HEAD.pack(b"PFOR", 1, len(doc_ids), len(ids), len(blocks))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), starts.tobytes(), *blocks])


class Shard:
    """A shard's documents and any range of its ids, by the block index."""

    def __init__(self, data: bytes):
        magic, version, n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != b"PFOR" or version != 1:
            raise ValueError("not a token shard")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.counts = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", n_blocks, at + 16 * n_docs)
        self.data, self.first = data, at + 16 * n_docs + 8 * n_blocks

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, np.uint32)
        blocks = range(start // BLOCK, (stop - 1) // BLOCK + 1)
        found = np.concatenate([decode_block(self.data, self.first + int(self.starts[b])) for b in blocks])
        return found[start - blocks[0] * BLOCK : stop - blocks[0] * BLOCK]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = 4_000_000) -> DataFrame:
    """Write shards under `folder`; return the manifest (path, task, seq, n_docs, n_ids), read from its table.

    Documents are dealt by ranges of doc_id, so a task holds one range and shards follow
    each other as (task, seq). A task holds one shard's ids at a time and one batch of
    texts. A repeated task writes the same bytes to the same names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        bpe = encoder(tokenizer_path)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            keys, counts, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            path = f"{folder}/shard-{task:06d}-{seq:05d}.pfor"
            write_file(path, encode_shard(keys, counts, ids))
            row = pa.RecordBatch.from_pylist([{"path": path, "task": task, "seq": seq, "n_docs": len(keys), "n_ids": len(ids)}], schema=manifest)
            seq += 1
            held.clear()
            return row

        for part in chunks(batches):
            ids, counts = bpe.ids(part.column(1), end_id)
            held.append((part.column(0).fill_null(MISSING).to_numpy(), counts, ids))
            if sum(len(h[2]) for h in held) >= shard_ids:
                yield flush()
        if held:
            yield flush()

    manifest = pa.schema([("path", pa.string()), ("task", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    ordered.mapInArrow(write, "path string, task long, seq long, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema("path string, task long, seq long, n_docs long, n_ids long").parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Each document's place and checksum, from the shards' bytes.

    A shard begins where the tasks before its own and the shards before it in its task end:
    the driver sums a row for each writing task, a window over each task's shards the rest.
    Each shard is read by one task.
    """
    spark = manifest.sparkSession
    totals = dict(manifest.groupBy("task").agg(F.sum("n_ids")).collect())  # a row for each writing task
    begins, start = [], 0
    for task in range(max(totals, default=-1) + 1):
        begins.append(start)
        start += totals.get(task, 0)
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("task").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.get(F.array(*map(F.lit, begins)), F.col("task").cast("int")) if begins else F.lit(0)
    files = manifest.select("path", (at.cast("long") + before).alias("start")).repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(read_file(path))
                ends = np.cumsum(shard.counts)
                begins = ends - shard.counts
                crc = []
                step, k = 512, 0
                for k in range(0, len(ends), step):
                    ids = shard.ids(int(begins[k]), int(ends[min(k + step, len(ends)) - 1])).astype("<u4").tobytes()
                    base = int(begins[k])
                    crc += [zlib.crc32(ids[4 * (int(a) - base) : 4 * (int(b) - base)]) for a, b in zip(begins[k : k + step], ends[k : k + step], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.doc_ids == MISSING), pa.array(first + begins), pa.array(shard.counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json")))
