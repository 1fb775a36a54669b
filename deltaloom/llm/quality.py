"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import lean
from .textblocks import M1, M4, U, flat, mix, word_hashes, words
from .toxicity import fold

#: Hashed features, and graded rows that the regression is fitted on at most (all of fewer, else an even sample by hash).
BITS, MAX_GRADED = 15, 12_000
#: Ridge penalty and steps of the fit.
RIDGE, STEPS = 2e-4, 150

#: Bytes as classes: small and capital letters, digits; other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123], _SHAPE[128:], _SHAPE[65:91], _SHAPE[48:58] = 97, 97, 65, 48


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a sparse matrix: places, values and row ends. A text's words, their shapes (class of the first
    and the last two bytes) and pairs of shapes are hashed; counts are damped and scaled to length 1. The last
    three places hold how varied the words are, how long the text and the words."""
    b, offsets = flat(column)
    starts, ends, counts = words(b, offsets)
    n = len(counts)
    text = np.repeat(np.arange(n), counts)
    word = word_hashes(b, starts)
    size = ends - starts
    shape = _SHAPE[b[starts]] * U(65536) + _SHAPE[b[ends - 1]] * U(256) + _SHAPE[b[np.maximum(ends - 2, starts)]] if len(starts) else word
    shape_hash = mix(shape * M1 + U(1))
    before = np.concatenate([np.zeros(1, np.uint64), shape_hash[:-1]]) if len(starts) else word
    room = (1 << BITS) - 3
    places = np.concatenate([(x % U(room)).astype(np.int64) for x in (word, shape_hash, mix(before * M4 + shape_hash))])
    keys, times = np.unique(np.tile(text, 3) * (1 << BITS) + places, return_counts=True)
    row, place = keys >> BITS, keys & ((1 << BITS) - 1)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / norm[row] if len(row) else value
    distinct = np.bincount(np.unique(text * (1 << 40) + (word >> U(24)).astype(np.int64)) >> 40, minlength=n) if len(text) else np.zeros(n)
    dense = np.stack([distinct / np.maximum(counts, 1), np.log1p(counts) / 10, np.bincount(text, size, n) / np.maximum(counts, 1) / 20], axis=1)
    row = np.concatenate([row, np.repeat(np.arange(n), 3)])
    place = np.concatenate([place, np.tile(np.arange(room, room + 3), n)])
    value = np.concatenate([value, np.clip(dense, 0, 3).ravel()])
    order = np.argsort(row, kind="stable")
    return place[order].astype(np.int32), value[order].astype(np.float32), np.cumsum(np.bincount(row, minlength=n))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[np.concatenate([[0], ends])])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]), with ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, column: pa.Array) -> np.ndarray:
        place, value, ends = features(column)
        return _sigmoid(_sums(self.weights[place] * value, ends)[:, None] - self.thresholds)


def fit_ordinal(place: np.ndarray, value: np.ndarray, ends: np.ndarray, grades: np.ndarray, levels: int) -> Ordinal:
    """Maximum likelihood of the proportional-odds model by Adam on all rows; thresholds stay ordered because
    all but the first are sums of exponentials."""
    n, k = len(grades), levels - 1
    row = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    above = (grades[:, None] > np.arange(k)).mean(axis=0).clip(1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    p = np.concatenate([np.zeros(1 << BITS), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, first, gap = p[: 1 << BITS], p[1 << BITS], np.exp(p[(1 << BITS) + 1 :])
        theta = np.concatenate([[first], first + np.cumsum(gap)])
        z = np.bincount(row, w[place] * value, n)
        tail = _sigmoid(z[:, None] - theta)  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        slope = edge * (1 - edge)
        i = np.arange(n)
        chance = np.maximum(edge[i, grades] - edge[i, grades + 1], 1e-12)
        dz = -(slope[i, grades] - slope[i, grades + 1]) / chance / n
        dtheta = np.zeros(k)
        for j in range(k):
            dtheta[j] = (slope[:, j + 1] * ((grades == j + 1) * 1.0 - (grades == j)) / chance).sum() / n
        g = np.zeros_like(p)
        g[: 1 << BITS] = np.bincount(place, dz[row] * value, 1 << BITS) + RIDGE * w
        g[1 << BITS] = dtheta.sum()
        for j in range(k - 1):
            g[(1 << BITS) + 1 + j] = dtheta[j + 1 :].sum() * gap[j]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 / (1 + step / 60) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    first, gap = p[1 << BITS], np.exp(p[(1 << BITS) + 1 :])
    return Ordinal(p[: 1 << BITS].astype(np.float32), np.concatenate([[first], first + np.cumsum(gap)]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place, value, ends = features(batch.column("text"))
        begin = [0, *ends[:-1].tolist()]
        cut = list(zip(begin, ends.tolist(), strict=True)) if len(ends) else []
        yield pa.RecordBatch.from_arrays([pa.array([place[s:e].tobytes() for s, e in cut], pa.binary()), pa.array([value[s:e].tobytes() for s, e in cut], pa.binary()), batch.column("grade")], ["place", "value", "grade"])


def fit(docs: DataFrame, ratings: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", levels: int = 3, max_graded: int = MAX_GRADED) -> Ordinal:
    """Fits on the graded rows (grades 0 to levels - 1) outside fold 2, max_graded at most, which come to the driver as
    hashed features. Repeated ratings of a document count as their highest; null grades are none. Without
    ratings all weights are 0 and all grades as likely."""
    marks = ratings.filter(F.col(grade).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("mark_id")).agg(F.max(F.col(grade).cast("int")).alias("grade"))
    marks = marks.filter(fold("mark_id") != 2)
    n = marks.count()
    if n > max_graded:
        marks = marks.filter(F.pmod(F.xxhash64("mark_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * max_graded / n))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(marks), F.col("doc_id") == F.col("mark_id")).select("text", "grade")
    got = rows.mapInArrow(lean(_rows), "place binary, value binary, grade int").toPandas()
    if not len(got):
        return Ordinal(np.zeros(1 << BITS, np.float32), np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1)))
    place = np.frombuffer(b"".join(got["place"]), np.int32)
    value = np.frombuffer(b"".join(got["value"]), np.float32)
    ends = np.cumsum([len(x) // 4 for x in got["place"]])
    return fit_ordinal(place, value, ends, got["grade"].to_numpy(np.int64).clip(0, levels - 1), levels)


def grade(docs: DataFrame, model: Ordinal, *, doc_id: str = "doc_id", text: str = "text", target: int = 1, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of target or a higher grade) and kept (it is least or more) of
    each row, from its whole text. Empty and null texts have the features of no words; repeated rows and null
    doc_id are graded each; an empty table gives an empty result; other columns are ignored. No shuffle."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = held.value.tails(batch.column("text"))
            tail = tails[:, target - 1] if len(tails) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], ["doc_id", "held_out", "expected_grade", "tail_probability", "kept"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold(doc_id) == 2).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, expected_grade double, tail_probability double, kept boolean")
