"""Operator 13, runs of words by Baier grouping.

A run is a maximal stretch of words with a period. Its Lyndon roots are the rotations of the
period that are least among their rotations; under one of the two orders of the words, each root
is the longest Lyndon word that begins at its place. So:

1. The first phase of Baier's suffix sorter groups suffixes, from the greatest group down: each
   suffix of a group lengthens the context of the nearest suffix to its left in a lower group.
   When a group's turn comes, its context is the longest Lyndon word at each of its places:
   the Lyndon array and the equality of Lyndon words fall out without sorting the suffixes.
2. Both orders are done. Places i, i+p, i+2p of one group whose context has p words are
   neighbouring roots; each chain of them (ROOTS or more, as a run of four periods has) is
   extended to both sides by the longest common extension of the first root and the next.
3. Stretches from both orders are united and those of enough words and periods are the runs.

Runs are sought where they can be: each three words of a run stand in it once more, a period
away, so words outside stretches of triples that their document repeats are in no run. Triples
are compared by a hash, which can only let too many through.

Documents are worked on in batches inside mapInArrow; nothing is shuffled.

Rows: a null text has no words; a null doc_id has no planted repetition; long texts count whole;
repeated rows have equal results; ties of exponents go to the smallest start, then period; columns
but doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import chunks
from .common import table

LEAST_WORDS = 6
LEAST_PERIODS = 4
ROOTS = LEAST_PERIODS - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def lyndon_groups(ranks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The length of the longest Lyndon word at each place, and a group number that places share exactly if those words are equal."""
    n = len(ranks)
    symbols = sorted(set(ranks))
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in ranks]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size, lower, upper = [1] * len(symbols), list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    upper[-1] = -1
    nearest = list(range(n))  # itself while its group waits, then a place to its left
    length = [0] * n
    current = len(symbols) - 1
    while current >= 0:
        here = [i for i in members[current] if group[i] == current]
        members[current] = []
        words = size[current]
        for i in here:
            length[i] = words
            nearest[i] = i - 1
        pointed: dict[int, int] = {}
        for i in here:
            j = i - 1
            while j >= 0 and nearest[j] != j:
                j = nearest[j]
            k = i
            while k >= 0 and k != j:  # shorten the path for the next ones
                nearest[k], k = j, nearest[k]
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for j, count in pointed.items():
            split.setdefault((count, group[j]), []).append(j)
        for count, old in sorted(split, reverse=True):
            new = len(size)
            above = upper[old]
            size.append(size[old] + count * words)
            members.append(split[count, old])
            lower.append(old)
            upper.append(above)
            upper[old] = new
            if above >= 0:
                lower[above] = new
            for j in split[count, old]:
                group[j] = new
        below = lower[current]
        if below >= 0:
            upper[below] = -1
        current = below
    return np.array(length, np.int64), np.array(group, np.int64)


def _extension(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and from b on (a < b), forward or backward, are equal; compared in blocks that double."""
    done, block = 0, 16
    limit = len(words) - b if step > 0 else a + 1
    while done < limit:
        block = min(block, limit - done)
        if step > 0:
            unlike = words[a + done : a + done + block] != words[b + done : b + done + block]
        else:
            unlike = (words[a - done - block + 1 : a - done + 1] != words[b - done - block + 1 : b - done + 1])[::-1]
        at = int(unlike.argmax())
        if unlike[at]:
            return done + at
        done += block
        block *= 2
    return limit


def find_runs(words: np.ndarray) -> set[Run]:
    """(start, length, period) of every run of a sequence of integers."""
    found = set()
    symbols, ranks = np.unique(words, return_inverse=True)
    for order in (ranks, len(symbols) - 1 - ranks):
        length, group = lyndon_groups(order.tolist())
        chained = np.arange(len(words))
        for _ in range(ROOTS - 1):
            after = chained + length[chained]
            ok = after < len(words)
            chained, after = chained[ok], after[ok]
            chained = after[group[after] == group[chained]] if len(after) else after
        ends = chained  # the last of ROOTS neighbouring roots
        heads = np.unique(ends - (ROOTS - 1) * length[ends]) if len(ends) else ends
        before = heads - length[heads]
        follows = (before >= 0) & (group[np.maximum(before, 0)] == group[heads])
        for i in heads[~follows].tolist():
            p = int(length[i])
            end = i + p + _extension(words, i, i + p, 1)
            start = i - _extension(words, i - 1, i + p - 1, -1)
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.add((start, end - start, p))
    return found


def _stretches(words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begins and ends of the words in triples that their document repeats; long enough ones alone."""
    if len(words) < LEAST_WORDS:
        return
    w = words.astype(np.uint64) + np.uint64(1)
    key = (((doc[:-2].astype(np.uint64) + np.uint64(1)) * _MIX ^ w[:-2]) * _MIX ^ w[1:-1]) * _MIX ^ w[2:]
    order = np.argsort(key * _MIX)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key) + 2, np.int8)
    again[1 + order[1:][same]] = 1
    again[1 + order[:-1][same]] = 1
    again[1:-1] &= doc[:-2] == doc[2:]
    edge = np.flatnonzero(np.diff(again))  # no triple spans documents, so no stretch does
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b + 2 - a >= LEAST_WORDS:
            yield a, b + 2


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the contract repeats them in a tenth of the documents."""
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """Kept words joined by one blank: of each run only the first period stays."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def documents_runs(ids: list[int | None], texts: list[str]) -> Iterator[tuple[list[bytes], list[Run]]]:
    """Each document's words (after the planted repetition) and its runs by start, then period."""
    words = [planted(t.encode("utf-8", "replace").split(), i) for i, t in zip(ids, texts, strict=True)]
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    codes = pa.array([w for doc in words for w in doc], pa.binary()).dictionary_encode().indices.to_numpy()
    doc = np.repeat(np.arange(len(words)), sizes)
    runs: list[list[Run]] = [[] for _ in words]
    for a, b in _stretches(codes, doc):
        d = int(doc[a])
        runs[d] += [(a - int(begin[d]) + start, length, period) for start, length, period in find_runs(codes[a:b])]
    for w, r in zip(words, runs, strict=True):
        yield w, sorted(r, key=lambda run: (run[0], run[2]))


RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs by start and period, and the text with each run collapsed to its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            ids = part.column(0).to_pylist()
            found = list(documents_runs(ids, part.column(1).to_pylist()))
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r in found], _RUN)
            texts = pa.array([collapsed(w, r) for w, r in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), runs, texts], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, RUNS)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    greater = lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best)
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    found = word_runs(table(spark, sf_dir, "documents")).withColumn("best", F.aggregate("runs", none, greater))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
