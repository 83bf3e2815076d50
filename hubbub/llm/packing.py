"""Operator 5, packing along a space-filling curve.

Each document becomes a hashed count vector of its token ids, unit length, projected to
three dimensions by a fixed Gaussian matrix; a Hilbert key orders the projections, so that
documents of like content lie near each other. Documents are laid end to end in the order
(Hilbert key, hash of doc_id, doc_id) and that stream is cut every 2048 tokens: a sequence
holds neighbours on the curve, and only the corpus's last sequence is padded.

The stream is never in one place. Ids are stored once, in the shared folder; quantiles of
the order key cut it into many small buckets; the tokens of each bucket are summed (a row a
bucket on the driver); each bucket then knows where in the stream it begins.

Rows: a null or empty text has its end id only; a long text is one document of as many
pieces as it needs; rows that repeat a doc_id stay documents of their own, equal ones in any
order; a null doc_id is carried as null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import chunks, encoder, vocabulary
from .common import stored, table

LENGTH = 2048
END_ID = 1
BUCKETS = 1024
DIMS = 3
BITS = 13
ORDER_SALT_BITS = 63 - DIMS * BITS


def projection(size: int = BUCKETS, dims: int = DIMS, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dims))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of rows of cells in [0, 2**bits), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            has = (x[i] & q) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(has, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def cells(ids: np.ndarray, counts: np.ndarray, matrix: np.ndarray, rows: int = 256) -> np.ndarray:
    """The grid cell of each document: hashed counts, unit length, projected, spread over the grid."""
    size, ends = len(matrix), np.cumsum(counts)
    bucket = ((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64) % size
    out = []
    for k in range(0, len(counts), rows):
        n = counts[k : k + rows]
        own = bucket[ends[k] - n[0] : ends[k + len(n) - 1]] + np.repeat(np.arange(len(n)) * size, n)
        roots = np.sqrt(np.bincount(own, minlength=len(n) * size).reshape(len(n), size))
        out.append((roots @ matrix) / np.sqrt(n)[:, None])
    at = np.concatenate(out)
    return np.clip((np.tanh(at / 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, spot (Hilbert key), n, ids (packed to 16 bits where the vocabulary allows)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, matrix = encoder(tokenizer_path), projection()
        unit = np.dtype("<u2" if bpe.tokenizer.get_vocab_size() <= 65536 else "<u4")
        for part in chunks(batches):
            ids, counts = bpe.ids(part.column(1), end_id)
            ends = np.concatenate(([0], np.cumsum(counts))) * unit.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype(unit))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hilbert_keys(cells(ids, counts, matrix), BITS)), pa.array(counts), packed], names=["doc_id", "spot", "n", "ids"])

    return rows.mapInArrow(encode, "doc_id long, spot long, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    spark = docs.sparkSession
    # rows without an id are told apart by their place in the input, as all could be copies of one text
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.col("doc_id"))
    salt = F.shiftrightunsigned(F.xxhash64(own), 64 - ORDER_SALT_BITS)
    ids = stored(tokenized(docs, tokenizer_path, end_id).withColumn("spot", F.shiftleft("spot", ORDER_SALT_BITS).bitwiseOR(salt)), "packing-ids")

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = 8 * partitions
    cuts = ids.agg(F.percentile_approx("spot", [k / n_buckets for k in range(1, n_buckets)], 20 * n_buckets).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts))
    placed = ids.withColumn("bucket", _bucket(cuts))
    sums = dict(placed.groupBy("bucket").agg(F.sum("n")).collect())
    starts, total = {}, 0
    for b in sorted(sums):
        starts[b] = total
        total += sums[b]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                cols: list[list] = [[] for _ in range(8)]
                for doc_id, b, n, packed in zip(*(batch.column(c).slice(k, 256).to_pylist() for c in ("doc_id", "bucket", "n", "ids")), strict=True):
                    if b != now:
                        now, at = b, starts[b]
                    own = np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4").astype("<u4")
                    done = 0
                    while done < n:
                        offset = at % length
                        take = min(n - done, length - offset)
                        piece = own[done : done + take].tobytes()
                        for c, v in zip(cols, (doc_id, done, take, zlib.crc32(piece), n, at // length, offset, piece), strict=True):
                            c.append(v)
                        done, at = done + take, at + take
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.binary())], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    ordered = placed.repartition(partitions, "bucket").sortWithinPartitions("bucket", "spot", F.col("doc_id").asc_nulls_first(), "n", "ids")
    return ordered.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def _bucket(cuts: list[int]) -> F.Column:
    """The number of cuts at or below spot, by binary search over them as one constant array."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    held, n = F.array(*map(F.lit, cuts)), F.lit(len(cuts))
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) <= F.col("spot")), at + step).otherwise(at))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).drop("ids")
