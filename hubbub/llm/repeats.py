"""Operator 4, removal of repeated 200-byte strings by hash-compared suffix sorting.

A window is a 200-byte string of a document. Windows are not shuffled one by one. Each is
owned by its minimizer: the leftmost of its GRAM-byte strings with the smallest hash. Equal
windows own equal minimizers at equal offsets, so only places of equal minimizers (units:
a run of windows with one owner) can hold repeats.

1. Prefix polynomial hashes give every gram's hash; units are (gram hash, hash of the
   unit's whole context, place). Grams that occur once are dropped by a count.
2. Contexts that occur twice or more are repeated as a whole: told by the gram's hash and a
   hash of all their bytes, 128 bits in all.
3. The windows of contexts that occur once, where other contexts share the gram, are
   compared with those contexts' windows: suffixes are sorted by mergesort; two are
   compared by binary search for their common extension over prefix hashes, eight steps
   for 200 bytes; neighbours that agree on 200 bytes are verified byte by byte.
4. Each document unites its repeated windows and drops the bytes they cover.

Contexts meet by the hash of the CORE bytes that all windows of a block of offsets share. A
core that more than HOT_CORE contexts have would be too much for one task: its windows are
counted one by one by a 128-bit hash of their bytes instead, wherever they lie.

Rows: a null text is empty; a long one counts whole; texts shorter than 200 bytes keep everything; rows that repeat
a document repeat its bytes and so remove them from each; a null doc_id is carried as null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

LENGTH = 200
GRAM = 48
BLOCK = 64
NO_ID = -(2**63)
_BASE = 0x9E3779B97F4A7C15
_ROOT = pow(_BASE, -1, 2**64)
_BYTES = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown as texts ask."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 17)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """p[i] is the sum of value(byte j) * base**j over j < i, modulo 2**64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * _power(_BASE, len(codes)), out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over every w neighbours: suffixes of one block with prefixes of the next."""
    n = len(x)
    held = np.full(-(-n // w) * w, fill, x.dtype)
    held[:n] = x
    rows = held.reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).ravel()
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def units(data: bytes, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(gram hash, gram place, first window, last window) of each unit; every window is in exactly one."""
    n, w = len(data), LENGTH - gram + 1
    if n < LENGTH:
        return None
    p = prefix_hashes(np.frombuffer(data, np.uint8))
    h = _mix((p[gram:] - p[:-gram]) * _power(_ROOT, n - gram + 1))
    least = _slide(h, w, np.minimum, 2**64 - 1)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(least)])) - 1
    around = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    around[w - 1 : w - 1 + len(least)] = least
    places = np.flatnonzero(_slide(around, w, np.maximum, 0) == h)
    _, kind = np.unique(np.concatenate((least[first], h[places])), return_inverse=True)
    run_key, place_key = kind[: len(first)] * (n + 1) + first, kind[len(first) :] * (n + 1) + places
    run_order, place_order = np.argsort(run_key), np.argsort(place_key)
    place = places[place_order]
    run = run_order[np.searchsorted(run_key[run_order], place_key[place_order], "right") - 1]
    before = np.full(len(place), -1)
    same = np.flatnonzero(h[place[1:]] == h[place[:-1]]) + 1
    before[same] = place[same - 1]
    lo = np.maximum(np.maximum(first[run], place - w + 1), before + 1)
    hi = np.minimum(last[run], place)
    ok = lo <= hi
    return h[place[ok]].view(np.int64), place[ok], lo[ok], hi[ok]


class Suffixes:
    """Suffixes of one byte string, compared over at most LENGTH bytes by their prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data, self.p, self.root = data, prefix_hashes(data), _power(_ROOT, len(data) + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes, up to LENGTH, that the suffixes from a and from b share: binary search on equal hashes."""
        low, step = np.zeros(len(a), np.int64), 1 << (LENGTH.bit_length() - 1)
        while step:
            mid = low + step
            fits = mid <= LENGTH
            end = np.where(fits, mid, low)
            same = (self.p[a + end] - self.p[a]) * self.root[a] == (self.p[b + end] - self.p[b]) * self.root[b]
            low = np.where(same & fits, mid, low)
            step >>= 1
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether the suffix from b sorts before that from a (or, with ties, is not after it)."""
        shared = self.common(a, b)
        at = np.minimum(shared, LENGTH - 1)
        return np.where(shared >= LENGTH, ties, self.data[b + at] < self.data[a + at])

    def sort(self, starts: np.ndarray, bucket_starts: np.ndarray) -> np.ndarray:
        """Mergesort inside each bucket (a stretch of starts); all merges of a level run at once."""
        out, n = starts.copy(), len(starts)
        sizes = np.diff(np.append(bucket_starts, n))
        begin, size = np.repeat(bucket_starts, sizes), np.repeat(sizes, sizes)
        width = 1
        while len(sizes) and width < sizes.max():
            i = np.flatnonzero(size > width)
            rank = i - begin[i]
            pair = rank // (2 * width) * (2 * width)
            left = rank - pair < width
            other_lo = begin[i] + pair + np.where(left, width, 0)
            other_hi = np.minimum(begin[i] + size[i], other_lo + width)
            other_lo = np.minimum(other_lo, other_hi)
            lo, hi = other_lo.copy(), other_hi.copy()
            own = out[i]
            while True:
                go = np.flatnonzero(lo < hi)
                if not len(go):
                    break
                mid = (lo[go] + hi[go]) // 2
                less = np.empty(len(go), bool)
                for side in (True, False):  # equal suffixes of the left run stay first
                    k = np.flatnonzero(left[go] == side)
                    less[k] = self.before(own[go[k]], out[mid[k]], not side)
                lo[go] = np.where(less, mid + 1, lo[go])
                hi[go] = np.where(less, hi[go], mid)
            within = rank - pair - np.where(left, 0, width)
            out[begin[i] + pair + within + (lo - other_lo)] = own
            width *= 2
        return out


def repeated_windows(contexts: list[bytes], offsets: list[int], grams: list[int], firsts: list[int], lasts: list[int]) -> list[np.ndarray]:
    """For each context, which of its windows first..last (offsets within it) another context has at the same distance from the same gram."""
    sizes = np.array([len(c) for c in contexts])
    base = np.cumsum(sizes) - sizes
    counts = np.array(lasts) - np.array(firsts) + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    local = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(firsts, counts)
    starts = base[owner] + local
    shift = np.asarray(offsets)[owner] - local
    order = np.lexsort((shift, np.asarray(grams)[owner]))
    key = np.stack([np.asarray(grams)[owner][order], shift[order]])
    fresh = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0)))
    suffixes = Suffixes(np.frombuffer(b"".join(contexts), np.uint8))
    buckets = np.flatnonzero(fresh)
    ranked = suffixes.sort(starts[order], buckets)
    a, b = ranked[:-1], ranked[1:]
    k = np.flatnonzero(~fresh[1:])
    k = k[suffixes.common(a[k], b[k]) >= LENGTH]
    data = suffixes.data
    real = [x for x in k if data[a[x] : a[x] + LENGTH].tobytes() == data[b[x] : b[x] + LENGTH].tobytes()]
    hit = np.zeros(len(data), bool)
    hit[a[real]] = True
    hit[b[real]] = True
    return [hit[base[c] + firsts[c] : base[c] + lasts[c] + 1] for c in range(len(contexts))]


def _rows(docs: DataFrame) -> DataFrame:
    """id, tag (tells texts of one id apart) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tag"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            for doc, tag, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                data = text.as_py().encode()
                found = units(data)
                if found is not None:
                    h, place, lo, hi = found
                    whole = [xxhash.xxh3_64_intdigest(data[a : b + LENGTH], int(g - a)) for a, b, g in zip(lo.tolist(), hi.tolist(), place.tolist(), strict=True)]
                    for c, v in zip(cols, (h, np.array(whole, np.uint64).view(np.int64), np.full(len(h), doc, np.int64), np.full(len(h), tag, np.int64), lo << 12 | hi - lo), strict=True):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["h", "whole", "id", "tag", "span"])


UNITS = "h long, whole long, id long, tag long, span long"


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            press = zstandard.ZstdCompressor(level=1)
            texts = pa.array([press.compress(t.as_py().encode()) for t in part.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["id", "tag", "data"])


def _text(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _in_batches(rows: Iterator[tuple], kinds: tuple[pa.DataType, ...], names: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most so many; no more of them are held at once."""
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names=names)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of offsets of each wanted unit, keyed by the bytes all windows of the block share."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return _in_batches(_blocks(batches), kinds, ["core", "h", "id", "tag", "single", "first", "more", "place", "data"], 4096)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in _slices(batches, 256):
        for doc, tag, data, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
            data = _text(data)
            found = units(data)
            place_of = dict(zip((found[2] << 12 | found[3] - found[2]).tolist(), found[1].tolist(), strict=True))
            for w in wanted:
                span = w["span"]
                lo, hi, place = span >> 12, (span >> 12) + (span & 4095), place_of[span]
                for block in range((place - hi) // BLOCK, (place - lo) // BLOCK + 1):
                    first, last = max(lo, place - (block + 1) * BLOCK + 1), min(hi, place - block * BLOCK)
                    core = place - block * BLOCK, place - (block + 1) * BLOCK + 1 + LENGTH
                    key = xxhash.xxh3_64_intdigest(data[core[0] : core[1]], block) - 2**63
                    yield key, w["h"], doc, tag, w["single"], first, last - first, place - first, data[first : last + LENGTH]


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


HOT_CORE = 1024
CONTEXTS = "core long, h long, id long, tag long, single boolean, first long, more int, place int, data binary"
#: Sorting needs some forty times as much memory: prefix hashes, powers, places and their temporaries.
SORT_BYTES = 4 << 20


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix-sort the contexts of whole cores, some megabytes at a time; rows arrive sorted by core."""
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        hits = repeated_windows([r[8] for r in held], [r[7] for r in held], [r[0] ^ r[1] for r in held], [0] * len(held), [r[6] for r in held])
        out = []
        for r, hit in zip(held, hits, strict=True):
            if r[4] and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                out += [(r[2], r[3], r[5] + int(a), r[5] + int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["id", "tag", "lo", "hi"])

    for part in _slices(batches, 1024):
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if row[0] != last and size > SORT_BYTES:
                yield from flush()
                held, size = [], 0
            held.append(row)
            last, size = row[0], size + len(row[8])
    if held:
        yield from flush()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of contexts one by one, as 128-bit hashes of their bytes."""

    def each() -> Iterator[tuple]:
        for part in _slices(batches, 1024):
            for doc, tag, single, first, more, data in zip(*(part.column(c).to_pylist() for c in ("id", "tag", "single", "first", "more", "data")), strict=True):
                for i in range(more + 1):
                    digest = xxhash.xxh3_128_digest(data[i : i + LENGTH])
                    yield int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), doc, tag, single, first + i

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    return _in_batches(each(), kinds, ["w1", "w2", "id", "tag", "single", "lo"], 16384)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches, 256):
        cols: list[list] = [[] for _ in range(6)]
        for doc, data, whole, single, parts in zip(*(c.to_pylist() for c in part.columns), strict=True):
            data = _text(data)
            n = len(data)
            edges = np.zeros(n + 1, np.int32)
            for span in set(whole or ()) - set(single or ()):
                edges[span >> 12] += 1
                edges[(span >> 12) + (span & 4095) + LENGTH] -= 1
            for run in parts or ():
                edges[run["lo"]] += 1
                edges[run["hi"] + LENGTH] -= 1
            gone = np.cumsum(edges[:n]) > 0
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if n else 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
            for c, v in zip(cols, (None if doc == NO_ID else doc, n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document."""
    rows = _rows(docs)
    every = rows.mapInArrow(_units, UNITS)
    again = stored(every.select("h").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "grams")
    found = stored(every.join(again, "h", "left_semi"), "units")
    place = F.struct("id", "tag", "span")
    kinds = stored(found.groupBy("h", "whole").agg(F.count("*").alias("n"), F.min(place).alias("at")), "contexts")
    single = kinds.where("n = 1")
    wanted = kinds.join(single.select("h").distinct(), "h", "left_semi").select("at.id", "at.tag", F.struct("at.span", "h", (F.col("n") == 1).alias("single")).alias("w"))
    wanted = wanted.groupBy("id", "tag").agg(F.collect_list("w").alias("wanted"))
    texts = rows.mapInArrow(_squeezed, "id long, tag long, data binary")
    one = texts.join(wanted, ["id", "tag"]).groupBy("id", "tag").agg(F.first("data").alias("data"), F.first("wanted").alias("wanted"))
    blocks = stored(one.select("id", "tag", "data", "wanted").mapInArrow(_contexts, CONTEXTS), "blocks")
    hot = stored(blocks.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CORE).select("core"), "hot-cores")
    cool = blocks.join(hot, "core", "left_anti").repartition("core").sortWithinPartitions("core").mapInArrow(_compared, "id long, tag long, lo long, hi long")
    each = stored(blocks.join(hot, "core", "left_semi").select("id", "tag", "single", "first", "more", "data").mapInArrow(_windows, "w1 long, w2 long, id long, tag long, single boolean, lo long"), "windows")
    shared = each.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    warm = each.where("single").join(shared, ["w1", "w2"], "left_semi").selectExpr("id", "tag", "lo", "lo hi")
    parts = stored(cool.unionByName(warm), "parts")
    marks = found.select("id", "tag", F.col("span").alias("whole"), F.lit(None).cast("long").alias("single"), F.lit(None).cast("struct<lo:long,hi:long>").alias("part"))
    marks = marks.unionAll(single.selectExpr("at.id", "at.tag", "cast(null as long)", "at.span", "cast(null as struct<lo:long,hi:long>)"))
    marks = marks.unionAll(parts.selectExpr("id", "tag", "cast(null as long)", "cast(null as long)", "struct(lo, hi)"))
    marks = marks.groupBy("id", "tag").agg(F.collect_set("whole").alias("whole"), F.collect_set("single").alias("single"), F.collect_set("part").alias("parts"))
    final = texts.join(marks, ["id", "tag"], "left").select("id", "data", "whole", "single", "parts")
    return final.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
