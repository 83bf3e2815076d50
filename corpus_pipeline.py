"""The corpus pipeline: documents in, packed sequences out.

Each stage works on what its predecessor kept, written as Parquet and read again; of the tables
that quality, near_dedup and decontam store on the way, only the keys that decide are kept:
quality (rejected documents go), near-duplicates (one document of each group stays),
benchmark leaks (documents that hold a benchmark item go), personal data (spans are
replaced by their kind) and packing (pieces of sequences). All but the last return the
columns of documents, whatever their names (those of KEY, ODD, GROUP and the score are reserved).

Rows: a null or empty text is judged by its statistics, never a copy or a leak, and packed
as an end id; long texts count whole; rows that repeat a document are copies of it; rows of
one doc_id with different texts, and rows without an id, are documents of their own in every
stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubbub.llm import decontam, near_dedup, packing, pii, quality
from hubbub.llm.bpe import vocabulary
from hubbub.llm.common import keep, removed, stored, table

#: Copies of one document share this percentage of their word shingles; op7_near_dedup's own contract is 85.
NEAR_PERCENT = 80
KEY, ODD, GROUP = "row key of the pipeline", "odd id of the pipeline", "group of the pipeline"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with removed(spark):
        model = quality.fit(docs, table(spark, sf_dir, "labels"))
    own = "quality score of the pipeline"
    return quality.score(docs, model, own).where(F.col(own) >= 0.5).drop(own)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY, equal for equal rows alone: the doc_id, but a hash of (doc_id, text) where ids are missing or repeated (ODD).

    No row is numbered, so a lost executor's rows get their keys again. Repeated ids are
    stored: few ids are a small table, which Spark then joins without moving texts.
    """
    own = F.xxhash64("doc_id", "text")
    known = docs.where("doc_id is not null")
    again = stored(known.groupBy("doc_id").agg(F.count("*").alias(ODD)).where(F.col(ODD) > 1), "repeated-ids")
    known = known.join(again, "doc_id", "left").select(*docs.columns, F.col(ODD).isNotNull().alias(ODD))
    rows = known.unionByName(docs.where("doc_id is null").withColumn(ODD, F.lit(True)))
    return rows.withColumn(KEY, F.when(F.col(ODD), own).otherwise(F.col("doc_id")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group (a null one last)."""
    rows = keyed(docs)
    with removed(spark):
        groups = near_dedup.near_duplicates(rows.select(F.col(KEY).alias("doc_id"), "text"), NEAR_PERCENT).select(F.col("doc_id").alias(KEY), F.col("component_id").alias(GROUP))
        odd = rows.where(F.col(ODD)).select(KEY, F.col("doc_id").alias("own")).distinct()
        first = F.struct((F.col(ODD).isNotNull() & F.col("own").isNull()).alias("missing"), F.coalesce("own", KEY).alias("own"), KEY)
        kept = groups.distinct().join(odd.withColumn(ODD, F.lit(True)), KEY, "left").groupBy(GROUP).agg(F.min(first).getField(KEY).alias(KEY)).select(KEY)
        kept = keep(kept, "kept-rows")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    plain, copies, empty = (rows.where(c).join(kept, KEY, "left_semi") for c in (~F.col(ODD), F.col(ODD) & words, F.col(ODD) & ~words))
    return plain.unionByName(copies.dropDuplicates([KEY])).unionByName(empty).select(docs.columns)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    with removed(spark):
        found = decontam.leaks(rows.select(F.col(KEY).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        found = keep(found.select(F.col("doc_id").alias(KEY)).distinct(), "leaked-rows")
    return rows.join(found, KEY, "left_anti").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontam", decontam_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: The stages learn models and hash, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
