"""Operator 7, near-duplicate documents by SuperMinHash.

A document's set holds its distinct 5-word shingles (64-bit hashes). In a SuperMinHash
signature each element visits the slots in its own random order and offers value + step at
its step; all elements step together and stop as soon as every slot is filled by a step
that later ones cannot beat. Bands are cut from signatures of SLOTS slots. Their number and
width follow from the similarity asked for (`tuned`): two sets of exactly that similarity
share no band with a chance of at most MISS (24 bands of 6 at 0.85, 29 of 5 at 0.80).

Equal sets are one class, found by a 128-bit hash of the set, so copies are never paired.
Classes that share a band are candidates. First each band's classes are compared with the
band's hub (the class whose bands are shared most); links are grouped; then every pair of a
band that is still in two groups is compared, unless sizes rule it out or signatures (4 bits
a slot) differ in more slots than a pair of that similarity does (chance at most MISS
again). A band with many such classes is dealt over tasks in blocks of PAIR_BLOCK. All links
are confirmed on full sets and grouped by union-find (graph.py).

Rows: a null, empty or word-free text has an empty set and no links; fewer words than five
are one shingle; rows that repeat a doc_id are one vertex (linked if any of them is); a
null doc_id is not linked, has a null component and is kept; a long text counts whole; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, utf8
from .graph import components

WORDS = 5
SLOTS = 288
BAND_SLOTS = 172  # the bands take about half of the slots
PERCENT = 85
MISS = 1.2e-5
PAIR_BLOCK = 1024
STEP = np.uint64(40)
_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tuned(percent: int) -> tuple[int, int, int]:
    """Bands, slots a band and the most unlike 4-bit slots at which a pair of exactly this similarity is missed by at most MISS."""
    same = percent / 100
    cuts = ((math.ceil(math.log(MISS) / math.log1p(-min(same**rows, 1 - 1e-9))), rows) for rows in range(1, BAND_SLOTS + 1))
    n_bands, rows = max((c for c in cuts if c[0] * c[1] <= BAND_SLOTS), key=lambda c: c[1])
    differ = (1 - same) * 15 / 16
    beyond, most = 0.0, SLOTS
    while most and (beyond := beyond + math.comb(SLOTS, most) * differ**most * (1 - differ) ** (SLOTS - most)) <= MISS:
        most -= 1
    return n_bands, rows, most


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = utf8(text).lower().split()  # bytes: ASCII letters and white space only
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    k = min(words, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _GOLD + h[i : n - k + 1 + i])
    return np.unique(out)


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of a non-empty array of distinct hashes: step in the high bits, value below."""
    best = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    order, rows = None, np.arange(len(elements))
    for j in range(slots):
        z = mix(elements + np.uint64(int(_GOLD) * (j + 1) % 2**64))
        k = j + (((z & np.uint64(0xFFFFFF)) * np.uint64(slots - j)) >> np.uint64(24)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                order[rows, first] = 0
            slot = order[rows, k]
            order[rows, k] = order[:, j]
        np.minimum.at(best, slot, (np.uint64(j) << STEP) | (z >> np.uint64(24)))
        if best.max() < np.uint64(j + 1) << STEP:
            break
    return best


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, n_bands + 1, dtype=np.uint64) * _GOLD
    for column in sig[: n_bands * rows].reshape(n_bands, rows).T:
        key = mix(key * _GOLD + column)
    return key.view(np.int64)


def four_bits(sig: np.ndarray) -> np.ndarray:
    """Four bits of each slot, sixteen slots a long."""
    nibbles = (mix(sig) & np.uint64(15)).reshape(-1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)


def unlike(a: str, b: str) -> str:
    """SQL for the number of slots whose four bits differ."""
    x = [f"({a}[{i}] ^ {b}[{i}])" for i in range(SLOTS // 16)]
    return " + ".join(f"bit_count(({v} | shiftrightunsigned({v}, 1) | shiftrightunsigned({v}, 2) | shiftrightunsigned({v}, 3)) & 1229782938247303441L)" for v in x)


def sketch(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128-bit hash of the set), bits and bands (null when the set is empty)."""
    n_bands, rows, _ = tuned(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n, s1, s2, bits, keys = [], [], [], [], []
                for text in part.column(1):
                    x = shingles(text.as_py())
                    n.append(len(x))
                    if not len(x):
                        s1.append(None), s2.append(None), bits.append(None), keys.append(None)
                        continue
                    digest = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
                    sig = signature(x)
                    s1.append(int(digest[0])), s2.append(int(digest[1])), bits.append(four_bits(sig)), keys.append(bands(sig, n_bands, rows))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bits, longs), pa.array(keys, longs)], names=["doc_id", "n", "s1", "s2", "bits", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bits array<long>, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity; texts holds (id, text) of all of them."""
    both = pairs.hint("merge").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").hint("merge").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = [(None, None), (None, None)]

        def shingled(k: int, text: str) -> np.ndarray:
            if last[k][0] != text:
                last[k] = (text, shingles(text))
            return last[k][1]

        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingled(0, ta.as_py()), shingled(1, tb.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(len(x)) and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for every row of docs."""
    sketches = stored(sketch(docs, percent), "sketches")
    known = sketches.where("doc_id is not null and n > 0")
    classes = stored(known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "classes")

    # every band of every class; bands that one class alone has are dropped
    rows = classes.selectExpr("rep", "s1", "n", "posexplode(bands) as (band, key)")
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # signatures are joined behind that, else every class would move its own once a band
    rows = stored(rows.join(shared, "key").join(classes.select("rep", "s1", "bits"), ["rep", "s1"]), "bands")
    weight = rows.groupBy("rep", "s1").agg(F.sum("size").alias("weight"))
    hubs = rows.join(weight, ["rep", "s1"]).groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("first"), "n", "bits")).alias("hub"))
    close = f"100 * least(n, m) >= {percent} * greatest(n, m) and {unlike('bits', 'others')} <= {tuned(percent)[2]}"
    stars = rows.join(hubs.selectExpr("key", "-hub.first hub", "hub.n m", "hub.bits others"), "key").where("rep <> hub").where(close)
    pairs = stored(stars.selectExpr("least(rep, hub) a", "greatest(rep, hub) b").distinct(), "pairs")
    # the texts of all candidates, fetched once; always by a merge join, as the ids grow with the corpus
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = stored(texts.join(rows.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi"), "dedup-texts")
    links = stored(confirmed(pairs, texts, percent), "links")

    # ids that several rows with different sets share
    same = known.join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select("doc_id", "rep")
    split = same.distinct().groupBy("doc_id").agg(F.min("rep").alias("least"), F.count("*").alias("sets")).where("sets > 1")
    edges = stored(links.unionAll(same.join(split.select("doc_id", "least"), "doc_id").selectExpr("rep a", "least b").where("a <> b").distinct()), "edges")
    groups = stored(components(edges), "groups")

    # pairs of a band whose classes are still in two groups
    grouped = rows.join(groups.withColumnsRenamed({"node": "rep", "component": "found"}), "rep", "left").withColumn("found", F.coalesce("found", "rep"))
    open_keys = grouped.groupBy("key").agg(F.min("found").alias("x"), F.max("found").alias("y"), F.ceil(F.count("*") / PAIR_BLOCK).alias("blocks")).where("x < y").select("key", "blocks")
    left = grouped.join(open_keys, "key").join(classes.select("rep", "s1", "bands"), ["rep", "s1"])
    scale = math.log(1.0001 * 100 / percent)  # sets that are alike are of one step of sizes or of neighbouring ones
    step = F.when(F.col("blocks") > 1, F.floor(F.log("n") / scale)).otherwise(0)  # small bands are one step, not two copies
    left = stored(left.select("key", "band", "rep", "n", "bits", "found", "bands", "blocks", step.alias("step")), "open")
    # the smaller set of a pair is dealt to one block of its band and step, the larger one goes to all of them
    steps = F.when(F.col("blocks") > 1, F.array("step", F.col("step") - 1)).otherwise(F.array("step"))
    other = left.select("key", F.explode(steps).alias("step"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("rep").alias("rep2"), F.col("n").alias("m"), F.col("bits").alias("others"), F.col("found").alias("found2"), F.col("bands").alias("bands2"))
    left = left.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    once = "not exists(sequence(0, band), i -> i < band and bands[i] = bands2[i])"  # each pair in its first shared band
    more = left.join(other, ["key", "step", "block"]).where("found <> found2 and (n < m or n = m and rep < rep2)").where(close).where(once).selectExpr("least(rep, rep2) a", "greatest(rep, rep2) b").distinct()
    more = stored(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    groups = stored(components(edges.unionAll(confirmed(more, texts, percent))), "groups")

    found = classes.select("s1", "s2", "n", "rep").join(groups.withColumnsRenamed({"node": "rep", "component": "found"}), "rep", "left").selectExpr("s1", "s2", "n", "coalesce(found, rep) component_id")
    out = sketches.select("doc_id", "n", "s1", "s2").join(found, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
