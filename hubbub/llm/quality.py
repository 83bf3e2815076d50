"""Operator 10, quality classifier: random Fourier features, ridge, isotonic calibration.

Statistics of the whole text (shares of character classes, words, repeats, the worst line)
are standardised and mapped by cos(Wx + b), an approximation of a Gaussian kernel. Each
partition sums its part of the normal equations; ridge regression on the labels solves
them; isotonic regression on a part of the sample that the ridge did not see turns the
values into probabilities.

The fit takes at most about SAMPLE labelled documents, chosen by a hash of doc_id, none of
them held out. Scores use the text alone. A null or empty text scores as the statistics of
an empty text; a doc_id with several labels has their mean; one with several texts teaches
with the smallest statistics; without labels every score is 0.5; with one class only,
scores are that class. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_held_out, stored, table, utf8

SAMPLE = 20_000
FEATURES = 384
RIDGE = 1e-2
PARTS = 8

_CLASSES = np.zeros((256, 8), np.float64)
for _k, _of in enumerate((range(65, 91), range(97, 123), range(48, 58), b" ", b".,;:'\"-()", b"!?", b"#$%&*<>{}[]=+~^@\\/_`", b"|")):
    _CLASSES[list(_of), _k] = 1
_UPPER = _CLASSES[:, 0].astype(np.float32)
_ODD = (_CLASSES[:, 5] + _CLASSES[:, 6] + _CLASSES[:, 7]).astype(np.float32)
N_STATS = 23


def statistics(text: str | None) -> np.ndarray:
    data = utf8(text)
    out = np.zeros(N_STATS)
    if not data.strip():
        return out
    codes = np.frombuffer(data, np.uint8)
    counts = np.bincount(codes, minlength=256)
    n = len(codes)
    shares = counts @ _CLASSES / n
    p = counts[counts > 0] / n
    words = data.split()
    kinds = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    m = len(words)
    begins = np.concatenate(([0], np.flatnonzero(codes == 10) + 1))
    begins = begins[begins < n]
    sizes = np.diff(np.append(begins, n))
    long = sizes >= min(20, sizes.max())
    odd = np.add.reduceat(_ODD[codes], begins)[long] / sizes[long]
    upper = np.add.reduceat(_UPPER[codes], begins)[long] / sizes[long]
    lines = data.split(b"\n")
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out[:8] = shares
    out[8:] = (
        np.log1p(n),
        (n - counts[:128].sum()) / n,
        -(p * np.log2(p)).sum(),
        lengths.mean(),
        lengths.std(),
        len(kinds) / m**0.8,
        max(kinds.values()) / m,
        repeats / m,
        np.log1p(repeats),
        odd.max(),
        upper.max(),
        1 - len(set(lines)) / len(lines),
        np.log1p(sizes.max()),
        np.log1p(m) - np.log1p(len(begins)),
        (counts[0x80:].sum() - counts[0xC2:].sum()) / n,
    )
    return out


@dataclass
class Quality:
    """A fitted classifier; score() takes rows of statistics."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, n: int = FEATURES, seed: int = 11) -> np.ndarray:
    """Rows of n random Fourier features and an intercept."""
    rng = np.random.default_rng(seed)
    z = np.clip((stats - mean) / scale, -4, 4)
    w = rng.standard_normal((z.shape[1], n)) / np.sqrt(z.shape[1])
    return np.hstack([np.cos(z @ w + rng.uniform(0, 2 * np.pi, n)) * np.sqrt(2 / n), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit by pooling adjacent violators; blocks are joined by lines."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a2, b2, c2 = blocks.pop()
            a1, b1, c1 = blocks.pop()
            blocks.append([(a1 * c1 + a2 * c2) / (c1 + c2), b1 + b2, c1 + c2])
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Quality | None:
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    n = known.count()
    if not n:
        return None
    kept = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n)) + 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(kept), "doc_id")  # at most about `sample` rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "y", "stats"])

    rows = texts.mapInArrow(measure, "doc_id long, y double, stats array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("stats").alias("stats"))
    rows = stored(rows.repartition(PARTS, "doc_id"), "quality-sample").withColumn("role", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)))
    if rows.isEmpty():
        return None
    moments = rows.agg(F.count("*").alias("n"), *[f(F.get("stats", F.lit(k))).alias(f"{f.__name__}{k}") for k in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([moments[f"avg{k}"] for k in range(N_STATS)])
    scale = np.array([moments[f"stddev_pop{k}"] or 0 for k in range(N_STATS)])
    scale[scale < 1e-9] = 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                x = fourier(np.array(batch.column(1).to_pylist()), mean, scale)
                total += x.T @ np.hstack([x, np.array(batch.column(0), float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

    parts = rows.where("role > 0").select("y", "stats").mapInArrow(normal, "total binary").collect()  # a row for each of PARTS files
    total = sum(np.frombuffer(p.total).reshape(FEATURES + 1, FEATURES + 2) for p in parts)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    model = Quality(mean, scale, weights, np.array([0.0]), np.array([0.5]))
    rest = rows.where("role = 0").select("y", "stats").collect()  # a quarter of the sample
    if not rest:
        rest = rows.select("y", "stats").limit(sample).collect()
    model.knots, model.values = isotonic(model.raw(np.array([r.stats for r in rest])), np.array([r.y for r in rest]))
    return model


def score(docs: DataFrame, model: Quality | None, name: str = "score") -> DataFrame:
    """docs with a column `name` (0 to 1) behind the others, which all pass through; a column of that name is an error."""
    if name in docs.columns:
        raise ValueError(f"documents have a column {name}; choose another name")
    schema = docs.withColumn(name, F.lit(0.0)).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = model.score(np.array([statistics(t.as_py()) for t in batch.column(at)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
