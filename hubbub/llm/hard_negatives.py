"""Operator 12, hard negatives by exact scores from residue matrices.

Scores are integer inner products. They come from float32 matrix products modulo several small
primes: components are reduced to balanced residues so small that a product of two blocks stays
below 2**24 and so is exact; Chinese remaindering (mixed radix, balanced digits, which gives the
sign directly) reconstructs the score. Primes are taken until their product exceeds twice the
greatest score that the table's own components allow.

1. Rows become (vec_id, label, components as integers); equal rows are one with a count.
2. Anchors, the stated query set, meet all rows in blocks: row blocks of at most BLOCK rows by
   hash, anchor blocks of at most BLOCK anchors, one task for each pair of blocks. Only a
   block's own best candidates leave it.
3. First pass: products inside labels alone; the first `positives` rows of each anchor, over all
   blocks by a window.
4. Second pass: the windows that the positives' scores open; products over all rows; the first
   `negatives` of each window inside the block, then over all blocks.

Rows: a null vec_id, label or vector, or a null or non-finite component keeps a row out; vectors
of unlike length are as if filled up with zeros; equal rows count as many, each other's other
rows, and a repeated anchor is answered as often as it stands; ties go to the smaller vec_id, then
to a hash; an anchor without positives, or with none of a score of 0 or more, has no rows (the
window of a negative score is empty); columns but vec_id, label and embedding are ignored; an
empty table gives no rows. Scores that could reach 2**62 raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

BLOCK = 65_536
LEAST_BLOCK = 512
TILE_ROWS, TILE_ANCHORS = 4096, 256
MOST_COLUMNS = 1024
EXACT = 2**24
LEAST = np.iinfo(np.int64).min


def moduli(greatest: int, width: int) -> list[int]:
    """Primes, at least two, whose product exceeds 2 * greatest + 1 and whose balanced residues give exact float32 sums over min(width, MOST_COLUMNS) products."""
    if greatest >= 2**62:
        raise ValueError("scores may exceed 62 bits")
    columns = max(1, min(width, MOST_COLUMNS))
    p, primes, product = min(4095, 2 * int((EXACT / columns) ** 0.5)), [], 1
    while len(primes) < 2 or product <= 2 * greatest + 1:
        while not all(p % q for q in range(2, int(p**0.5) + 1)) or ((p - 1) // 2) ** 2 * columns >= EXACT:
            p -= 1
        primes.append(p)
        product *= p
        p -= 1
    return primes


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """float32 integers below 2**24 modulo p, between -(p-1)/2 and (p-1)/2.

    One step may miss by a period where the quotient is large; the second cannot.
    """
    q, r = np.float32(p), np.float32(1 / p)
    x = x - q * np.rint(x * r)
    return x - q * np.rint(x * r)


class Residues:
    """Rows of integers as float32 matrices modulo each prime."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [((rows + (p - 1) // 2) % p - (p - 1) // 2).astype(np.float32) for p in primes]

    def take(self, which: np.ndarray | slice) -> Residues:
        some = object.__new__(Residues)
        some.primes, some.parts = self.primes, [m[which] for m in self.parts]
        return some

    def products(self, other: Residues) -> np.ndarray:
        """Exact inner products of all rows with all rows of other."""
        digits: list[np.ndarray] = []
        for k, p in enumerate(self.primes):
            a, b = self.parts[k], other.parts[k]
            x = np.zeros((len(a), len(b)), np.float32)
            for c in range(0, a.shape[1], MOST_COLUMNS):
                x = balanced(x + balanced(a[:, c : c + MOST_COLUMNS] @ b[:, c : c + MOST_COLUMNS].T, p), p)
            for q, digit in zip(self.primes, digits):  # x becomes (x - digit) / q modulo p
                inverse = pow(q, -1, p)
                x = balanced(balanced(x - digit, p) * np.float32(inverse - p if inverse > p // 2 else inverse), p)
            digits.append(x)
        score = digits[-1].astype(np.int64)
        for p, digit in zip(self.primes[-2::-1], digits[-2::-1]):
            score *= p
            score += digit.astype(np.int64)
        return score


def first_of(group: np.ndarray, score: np.ndarray, order: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Which entries are needed for the first `most` of each group by score (high first), then order; each stands for count rows."""
    if not len(group):
        return np.empty(0, np.int64)
    rank = np.lexsort((order, -score, group))
    g, n = group[rank], np.cumsum(np.minimum(count[rank], most))
    fresh = np.concatenate(([True], g[1:] != g[:-1]))
    before = n - np.minimum(count[rank], most)
    return rank[before - before[fresh][np.cumsum(fresh) - 1] < most]


class Best:
    """The first `most` entries of each group met so far, and the score that a further one must reach."""

    def __init__(self, groups: int, most: int):
        self.most, self.least = most, np.full(groups, LEAST)
        self.group, self.score, self.order, self.count = (np.empty(0, np.int64) for _ in range(4))

    def add(self, group: np.ndarray, score: np.ndarray, order: np.ndarray, count: np.ndarray) -> None:
        every = [np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.order, order), (self.count, count))]
        keep = first_of(*every, self.most)
        self.group, self.score, self.order, self.count = (x[keep] for x in every)
        held = np.zeros(len(self.least), np.int64)
        np.add.at(held, self.group, np.minimum(self.count, self.most))
        last = np.full(len(self.least), np.iinfo(np.int64).max)
        np.minimum.at(last, self.group, self.score)
        full = held >= self.most
        self.least[full] = last[full]


def tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(k, min(n, k + size)) for k in range(0, n, size))


class Block:
    """One task's rows or anchors, rows by vec_id."""

    def __init__(self, rows: pa.Table, width: int, primes: list[int]):
        ids, tags = rows["vec_id"].to_numpy(), rows["tag"].to_numpy()
        order = np.lexsort((tags, ids))
        self.ids, self.tags, self.twins = ids[order], tags[order], rows["twin"].to_numpy()[order]
        self.labels, self.counts = rows["label"].to_numpy()[order], rows["n"].to_numpy()[order]
        self.order = order
        held = rows["vector"].to_pylist()
        matrix = np.zeros((len(held), width), np.int64)
        for to, k in enumerate(order.tolist()):
            own = np.frombuffer(held[k], "<i4")
            matrix[to, : len(own)] = own
        self.residues = Residues(matrix, primes)

    def others(self, anchors: Block, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """How many rows each entry r stands for, beside the anchor a itself."""
        own = (self.ids[r] == anchors.ids[a]) & (self.tags[r] == anchors.tags[a]) & (self.twins[r] == anchors.twins[a])
        return self.counts[r] - own


def best_of_own_label(anchors: Block, rows: Block, most: int) -> Best:
    best = Best(len(anchors.ids), most)
    for label in np.intersect1d(anchors.labels, rows.labels).tolist():
        own_a, own_r = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
        for ta in tiles(len(own_a), TILE_ANCHORS):
            ia = own_a[ta]
            left = anchors.residues.take(ia)
            for tr in tiles(len(own_r), TILE_ROWS):
                ir = own_r[tr]
                score = left.products(rows.residues.take(ir))
                k = max(0, len(ir) - most - 1)  # one may be the anchor itself
                floor = np.maximum(best.least[ia], np.partition(score, k, axis=1)[:, k])
                a, r = np.nonzero(score >= floor[:, None])
                count = rows.others(anchors, ia[a], ir[r])
                some = count > 0
                best.add(ia[a][some], score[a, r][some], ir[r][some], count[some])
    return best


def best_in_windows(anchors: Block, rows: Block, low: np.ndarray, high: np.ndarray, most: int) -> Best:
    """Groups are anchor * windows + window; low and high are matrices (anchor, window), empty windows have low > high."""
    windows = low.shape[1]
    best = Best(low.size, most)
    for ta in tiles(len(anchors.ids), TILE_ANCHORS):
        left, lo, hi = anchors.residues.take(ta), low[ta], high[ta]
        for tr in tiles(len(rows.ids), TILE_ROWS):
            score = left.products(rows.residues.take(tr))
            floor = np.maximum(lo, best.least.reshape(-1, windows)[ta])
            open_ = floor <= hi
            floor = np.where(open_, floor, np.iinfo(np.int64).max)
            a, r = np.nonzero((score >= floor.min(1)[:, None]) & (score <= np.where(open_, hi, LEAST).max(1)[:, None]) & (anchors.labels[ta][:, None] != rows.labels[tr][None, :]))
            s, r = score[a, r], r + tr.start
            for w in range(windows):
                inside = (s >= floor[a, w]) & (s <= hi[a, w])
                best.add((a[inside] + ta.start) * windows + w, s[inside], r[inside], rows.counts[r[inside]])
    return best


FOUND = "anchor_id long, anchor_tag long, anchor_twin long, slot int, vec_id long, tag long, score long, n long"


def _table(anchors: Block, rows: Block, best: Best, windows: int) -> pa.Table:
    a, r = best.group // windows, best.order
    cols = (anchors.ids[a], anchors.tags[a], anchors.twins[a], (best.group % windows).astype(np.int32), rows.ids[r], rows.tags[r], best.score, best.count)
    return pa.table([pa.array(c) for c in cols], names=[c.split()[0] for c in FOUND.split(", ")])


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (little-endian signed 32-bit integers, floor(scale * component)), greatest (component, absolute), tag and twin (hashes), n (equal rows): distinct rows that take part."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    sound = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.array(v, np.int64) for v in batch.column(2).to_pylist()]
            if any(len(v) and np.abs(v).max() >= 2**31 for v in held):
                raise ValueError("a component is too large for 32 bits")
            greatest = pa.array([int(np.abs(v).max()) if len(v) else 0 for v in held], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.astype("<i4").tobytes() for v in held], pa.binary()), greatest], names=["vec_id", "label", "vector", "greatest"])

    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    packed = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("vector")).mapInArrow(pack, "vec_id long, label long, vector binary, greatest long")
    again = packed.groupBy("vec_id", "label", "vector").agg(F.count("*").alias("n"), F.first("greatest").alias("greatest"))
    return again.select("*", F.xxhash64("vector", "label").alias("tag"), F.xxhash64(F.lit(7), "label", "vector").alias("twin"))


def in_blocks(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], each: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """each(anchor block, row block) for all pairs of blocks; both sides are dealt by hash, so a lost task's rows come back to it."""
    spark = rows.sparkSession
    n_anchors, n_rows = sizes
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(-(-n_rows // BLOCK), min(at_once, -(-n_rows // LEAST_BLOCK)), 1)
    anchor_blocks = max(-(-n_anchors // BLOCK), 1)
    own = lambda n: F.pmod(F.xxhash64("vec_id", "tag", "twin"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.select("*", own(anchor_blocks).alias("ab"), every(row_blocks).alias("rb"))
    fresh = rows.toDF(*rows.columns)  # a cogroup loses columns that both sides take from one read
    right = fresh.select("*", every(anchor_blocks).alias("ab"), own(row_blocks).alias("rb"))
    none = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in FOUND.split(", ")]).empty_table()

    def met(a: pa.Table, r: pa.Table) -> pa.Table:
        return each(a, r) if a.num_rows and r.num_rows else none

    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(met, FOUND)


def taken(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first `most` rows for each key over all blocks: score high first, then vec_id, tag; n is how many copies of a row are among them."""
    order = [F.desc("score"), "vec_id", "tag"]
    few = found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return few.withColumn("before", before).where(F.col("before") < most).withColumn("n", F.least("n", F.lit(most) - F.col("before")))


KEY = ["anchor_id", "anchor_tag", "anchor_twin"]


def hard_negatives(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    embeddings has vec_id, label and embedding; is_anchor is a condition on vec_id. A negative's
    score lies between percent of its positive's score and that score.
    """
    rows = stored(quantised(embeddings), "vectors")
    anchors = rows.where(is_anchor)
    size, greatest, n_rows, n_anchors = rows.agg(F.max(F.octet_length("vector")), F.max("greatest"), F.count("*"), F.count(F.when(is_anchor, 1))).first()
    width = (size or 0) // 4
    primes = moduli(width * (greatest or 0) ** 2, width)

    def own_label(left: pa.Table, right: pa.Table) -> pa.Table:
        a, r = Block(left, width, primes), Block(right, width, primes)
        return _table(a, r, best_of_own_label(a, r, positives), 1)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        a, r = Block(left, width, primes), Block(right, width, primes)
        high, low = np.full((len(a.ids), positives), LEAST), np.full((len(a.ids), positives), 0)
        scores = left["scores"].to_pylist()
        for to, k in enumerate(a.order.tolist()):
            own = np.array(scores[k], np.int64)
            high[to, : len(own)], low[to, : len(own)] = own, [-(-percent * s // 100) for s in scores[k]]
        return _table(a, r, best_in_windows(a, r, low, high, negatives), positives)

    first = taken(in_blocks(anchors, rows, (n_anchors, n_rows), own_label), KEY, positives)
    row = F.struct((-F.col("score")).alias("less"), "vec_id", "tag", "n")
    copies = F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.array_repeat(r, r.n.cast("int"))))
    pairs = stored(first.groupBy(*KEY).agg(copies.alias("best")), "positives")
    known = anchors.join(pairs.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_tag").alias("tag"), F.col("anchor_twin").alias("twin"), F.transform("best", lambda r: -r.less).alias("scores")), ["vec_id", "tag", "twin"])
    found = taken(in_blocks(known, rows, (n_anchors, n_rows), windows), [*KEY, "slot"], negatives)
    ranked = found.select(*KEY, "slot", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.explode(F.sequence((F.col("before") + 1).cast("int"), (F.col("before") + F.col("n")).cast("int"))).alias("rank"))
    each = pairs.select(*KEY, F.posexplode("best").alias("slot", "positive"))
    twins = anchors.where("n > 1").select(F.col("vec_id").alias("anchor_id"), F.col("tag").alias("anchor_tag"), F.col("twin").alias("anchor_twin"), F.col("n").alias("times"))
    out = ranked.join(each, [*KEY, "slot"]).join(twins, KEY, "left")
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    return out.select("anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank", "negative_id", (-F.col("positive.less")).alias("positive_score"), "negative_score", (F.col("slot") + 1).alias("positive_rank"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0).drop("positive_rank")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""
