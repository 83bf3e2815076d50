"""Operator 2, language identification by nearest centroid.

A text is a bag of hashed byte 3-grams of its lower-cased letters, weighted by (1 + log tf)
times inverse document frequency, unit length. Each language has CENTROIDS centroids from
spherical k-means; the language of the nearest one by cosine wins. A text farther from it
than almost all of that language's own sample is marked `rejected`; lang_pred still names
the nearest language.

Document frequencies count every document that may teach. The centroids are fitted on at
most SAMPLE distinct texts, shared evenly by the languages (at least CENTROIDS each): of
every language those of the smallest hashes, so that no language is lost to its copies. A
null text or one without a letter is `und` with score 0 and rejected; a long text counts
whole. Without any labelled document everything is `und`. Repeated rows repeat their result;
ties go to the first language by name; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import is_held_out, table

SIZE = 4096
SAMPLE = 1600
CENTROIDS = 4
SPLITS = 64
UND = "und"
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed 3-gram counts over the whole text."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split()) + b" "
    c = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(c) < 3:
        return np.zeros(SIZE, np.int64)
    h = (c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]) * np.uint32(2654435761)
    return np.bincount(h >> np.uint32(20), minlength=SIZE)


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    tf = counts(text)
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    size = np.sqrt(v @ v)
    return (v / size if size else v).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str]
    owner: np.ndarray
    centres: np.ndarray
    least: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = vectors @ self.centres.T
        best = cosines.argmax(1)
        return best, np.clip(cosines[np.arange(len(best)), best], 0, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centres, begun from the mean's nearest row and then the farthest from all so far."""
    centres = [x[(x @ x.mean(0)).argmax()]]
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.array(centres).T).max(1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Centroids | None:
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("doc_id")).select("lang", "text")
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df[:SIZE] += counts(text.as_py()) > 0
                n += 1
        df[SIZE] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(df)], names=["gram", "df"])

    rows = taught.select("text").mapInArrow(frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(SIZE + 1)
    for r in rows:
        df[r.gram] = r.df
    idf = np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1

    # for every language its texts of the smallest hashes, copies once: as many distinct texts as there are, `each` at most
    key = F.xxhash64("text").alias("key")
    langs = taught.select("lang").distinct().count()
    if not langs:
        return None
    each = max(k, sample // langs)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, keys = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            for lang in set(names):
                held[lang] = np.unique(np.concatenate((held.get(lang, keys[:0]), keys[names == lang])))[:each]
        for lang, keys in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64())], names=["lang", "key"])

    least = taught.where(F.col("text").rlike(r"\p{L}")).select("lang", key).mapInArrow(smallest, "lang string, key long").distinct()
    place = F.row_number().over(Window.partitionBy("lang", F.pmod("key", F.lit(SPLITS))).orderBy("key"))
    least = least.withColumn("place", place).where(F.col("place") <= each).groupBy("lang").agg(F.slice(F.array_sort(F.collect_list("key")), 1, each).alias("key"))
    chosen = taught.withColumn("key", F.xxhash64("text")).join(F.broadcast(least.select("lang", F.explode("key").alias("key"))), ["lang", "key"]).groupBy("lang", "key").agg(F.any_value("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, key, vector(t, idf).astype("<f2").tobytes()) for lang, t, key in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())], names=["lang", "key", "v"])

    rows = chosen.select("lang", "text", "key").mapInArrow(vectors, "lang string, key long, v binary")
    by: dict[str, dict[int, np.ndarray]] = {}
    for r in rows.collect():  # `each` rows a language at most
        by.setdefault(r.lang, {})[r.key] = np.frombuffer(r.v, "<f2").astype(np.float32)
    langs, owner, centres, least = sorted(by), [], [], []
    for i, lang in enumerate(langs):
        x = np.array([by[lang][key] for key in sorted(by[lang])])
        c = spherical_kmeans(x, k)
        owner += [i] * len(c)
        centres.append(c)
        least.append(0.8 * float(np.quantile((x @ c.T).max(1), 0.01)))
    return Centroids(idf, langs, np.array(owner), np.vstack(centres), np.array(least)) if langs else None


def predict(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected; looks at the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            lang, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            usable = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for k in range(0, len(usable), 256):
                at = usable[k : k + 256]
                best, cosine = model.nearest(np.array([vector(texts[i], model.idf) for i in at]))
                own = model.owner[best]
                score[at], rejected[at] = cosine, cosine < model.least[own]
                for i, j in zip(at, own, strict=True):
                    lang[i] = model.langs[j]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
