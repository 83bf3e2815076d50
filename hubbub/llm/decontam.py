"""Operator 6 [native], benchmark decontamination by SimHash windows.

Words are lower-cased and split at ASCII white space. A window of a document has an item's
length in words (or is the whole document, if that is shorter); a leak is a window whose
weighted 5-word shingles (weight: occurrences) reach THRESHOLD by weighted Jaccard with the
item's.

A window of m places reaches t against an item of L places only if at most
(m - tL) / (1 + t) of its shingles are foreign to the item, in whatever order they stand.
Places divisible by STRIDE are joined with the benchmark's shingles; where a window can
hold so many of these matches, a segment of the document is cut. In it all places are
matched, and every window start that keeps the bound (`_starts`) is verified by its exact
weighted similarity. Nothing else of the corpus is shuffled, and no other test removes a
window: 64-bit SimHash fingerprints of item and best window give `distance`, which is
reported but decides nothing, as repeated words put true leaks at any distance.

The benchmark's shingles are broadcast only after a count shows at most BROADCAST_ROWS rows;
a larger benchmark is joined by a shuffle. Rows: null or word-free texts and items match
nothing; an item of fewer words than five has one shingle; rows that repeat a doc_id or an
item_id are taken together (the best window counts, ties go to the first place); a null
doc_id or item_id is never reported; other columns are ignored; an empty table on either
side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPLIT, stored, table

WORDS = 5
STRIDE = 4
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SPLIT), lambda w: w != "")


def _shingle_strings(of: str, width: int | str = WORDS) -> str:
    return f"if(size({of}) = 0, array(), transform(sequence(0, greatest(size({of}) - {width}, 0)), i -> concat_ws(' ', slice({of}, i + 1, {width}))))"


def _simhash(of: str) -> str:
    """64 signs of the summed shingle hashes as a long; `of` is an array of shingle hashes."""
    bit = f"aggregate({of}, 0, (n, h) -> n + cast(shiftright(h, b) & 1 as int) * 2 - 1) > 0"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> if({bit}, f | shiftleft(1L, b), f))"


def _hashed(frame: DataFrame, of: str) -> DataFrame:
    """frame with `print`, the fingerprint of the shingles `of`, each hashed once (explode: not folded into the 64 sums)."""
    hashes = F.expr(f"array(transform({of}, s -> xxhash64(s)))")
    return frame.withColumn("hashes", F.explode(hashes)).withColumn("print", F.expr(_simhash("hashes"))).drop("hashes")


def _foreign(threshold: float) -> str:
    """The most places of a window that may be foreign to the item: own_places are the item's, m the window's."""
    return f"cast(floor((m - {threshold!r}D * own_places) / {1 + threshold!r}D + 1e-9D) as int)"


def _starts(at: str, least: str) -> str:
    """Ascending starts of the windows of own_places places that hold so many of the sorted places `at`, each once."""
    first = f"greatest(0, {at}[i + {least} - 1] - own_places + 1, coalesce(get({at}, i - 1) + 1, 0))"
    return f"if(size({at}) < {least}, array(), flatten(transform(sequence(0, size({at}) - {least}), i -> if({at}[i + {least} - 1] - {at}[i] >= own_places, array(), sequence({first}, {at}[i])))))"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start (word), similarity, distance: the best window of every leaked item in every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0")
    items = _hashed(items.withColumn("own", F.expr(_shingle_strings("w"))), "own")
    items = stored(items.select(F.monotonically_increasing_id().alias("row"), "item_id", F.size("w").alias("len"), "own", "print"), "benchmark")
    sizes = items.groupBy("len").agg(F.sum(F.size("own")).alias("n")).collect()  # a row for each item length
    n_rows = sum(r.n for r in sizes)
    lost = (1 - threshold) / (1 + threshold)
    stride = STRIDE if all(max(1, r.len - WORDS + 1) // STRIDE > int(max(1, r.len - WORDS + 1) * lost + 1e-9) for r in sizes) else 1
    lengths = sorted({min(r.len, WORDS) for r in sizes}) or [WORDS]

    # places where a document and an item share a shingle
    keys = items.select("row", "len", F.explode("own").alias("s")).select(F.xxhash64("s").alias("key"), "row", "len").distinct()
    keys = F.broadcast(keys) if n_rows <= BROADCAST_ROWS else keys
    split = texts.select("doc_id", words(F.col("text")).alias("w"))
    places = " , ".join(f"if(size(w) < {k}, array(), transform(sequence(0, size(w) - {k}, {stride if k == WORDS else 1}), i -> struct(i as pos, xxhash64(concat_ws(' ', slice(w, i + 1, {k}))) as key)))" for k in lengths)
    hits = split.select("doc_id", F.size("w").alias("n"), F.explode(F.expr(f"concat({places})")).alias("p")).select("doc_id", "n", "p.pos", "p.key").join(keys, "key")

    # segments that hold every window with enough of these places; rows of one doc_id only add to them
    own_places, m = F.expr(f"greatest(1, len - {WORDS - 1})"), F.expr(f"least(own_places, greatest(1, n - least(len, {WORDS}) + 1))")
    near = hits.groupBy("doc_id", "row", "len").agg(F.min("n").alias("n"), F.array_sort(F.collect_set("pos")).alias("at")).withColumn("own_places", own_places).withColumn("m", m)
    near = near.withColumn("enough", F.expr(f"greatest(1, cast(floor(m / {stride}) as int) - {_foreign(threshold)})")).withColumn("starts", F.expr(_starts("at", "enough"))).where("size(starts) > 0")
    near = near.groupBy("doc_id").agg(F.collect_list(F.expr("struct(row, len, starts[0] as low, array_max(starts) as high)")).alias("wanted"))
    held = texts.join(near, "doc_id").select("doc_id", "wanted", words(F.col("text")).alias("w"))
    cut = held.select("doc_id", F.size("w").alias("n"), F.explode(F.expr("transform(wanted, x -> struct(x.row as row, x.low as low, x.high as high, slice(w, x.low + 1, x.high - x.low + x.len) as part))")).alias("x"))
    items = F.broadcast(items) if n_rows <= BROADCAST_ROWS else items
    cut = cut.select("doc_id", "n", "x.*").join(items, "row").withColumn("own_places", own_places).withColumn("m", m)

    # windows: every start in a segment that keeps the bound over all places
    cut = cut.withColumn("grams", F.expr(_shingle_strings("part", f"least(len, {WORDS})"))).withColumn("at", F.expr("filter(transform(grams, (g, i) -> if(array_contains(own, g), i, -1)), i -> i >= 0)"))
    cut = cut.withColumn("enough", F.expr(f"greatest(1, m - {_foreign(threshold)})")).withColumn("first", F.explode(F.expr(_starts("at", "enough")))).where("low + first <= least(high, greatest(0, n - len))")
    found = cut.select("doc_id", "item_id", "own", "print", F.expr("low + first as start"), F.expr("slice(part, first + 1, len)").alias("v"))
    found = found.withColumn("shingles", F.expr(_shingle_strings("v"))).drop("v")
    # explode: computed once, where a filter pushed below would compute it again
    shared = "aggregate(array_distinct(shingles), 0, (n, s) -> n + least(size(filter(shingles, x -> x = s)), size(filter(own, x -> x = s))))"
    found = found.withColumn("shared", F.explode(F.array(F.expr(shared)))).withColumn("similarity", F.expr("shared / (size(shingles) + size(own) - shared)")).where(F.col("similarity") >= threshold)
    found = _hashed(found.withColumnRenamed("print", "others"), "shingles").withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("others"))))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("first"), (-F.col("distance")).alias("near"))).alias("best"))
    return best.select("doc_id", "item_id", F.expr("-best.first").alias("start"), F.expr("best.similarity").alias("similarity"), F.expr("-best.near").alias("distance"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
