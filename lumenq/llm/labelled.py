"""A bounded sample of labelled texts, and probability calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-grams of one labelled text that a model is fitted on at most: those of the smallest hashes.
MOST_SLOTS = 1 << 13


def _bounded(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The MOST_SLOTS features of the smallest hashes, which are a fair sample of any text's."""
    if len(at) <= MOST_SLOTS:
        return at, value
    mixed = at.astype(np.uint32) * np.uint32(0x9E3779B1)
    chosen = np.sort(np.argsort(mixed ^ (mixed >> np.uint32(15)), kind="stable")[:MOST_SLOTS])
    return at[chosen], value[chosen]


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, rows: int, features: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], usable=None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Feature indices and values, and labels, of at most `rows` labelled texts.

    The sample is the labelled ids with the smallest hashes, so reruns agree. An id
    with two labels, or with a null one, is left out, and so is a text that is null.
    Features are computed where the texts are; only they come to the driver, at most
    MOST_SLOTS for each text.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & (usable(F.col("id")) if usable else F.lit(True)))
        .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y_most"), F.count_if(F.col("y").isNull()).alias("nulls"))
        .where((F.col("y") == F.col("y_most")) & (F.col("nulls") == 0) & F.col("y").isin(0, 1))
        .orderBy(F.xxhash64("id"), "id").limit(rows).select("id", "y")
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).where("id is not null and text is not null")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_bounded(*x) for x in features(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([i.tolist() for i, _ in found], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float32()))], names=["id", "y", "at", "value"])

    # known has at most `rows` rows, so the broadcast is bounded
    found = texts.join(F.broadcast(known), "id").mapInArrow(of, "id long, y int, at array<int>, value array<float>").toArrow()
    found = found.sort_by("id").combine_chunks()
    pick = lambda name, kind: [np.asarray(x.values.to_numpy(zero_copy_only=False), kind) for x in found.column(name)]
    return list(zip(pick("at", np.int32), pick("value", np.float32), strict=True)), np.asarray(found.column("y").to_numpy(), np.int32)


def fit_sigmoid(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a > 0 and b of 1 / (1 + exp(-(a * score + b))), by damped Newton steps on smoothed targets."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    unit = float(np.std(scores)) or 1.0
    x = np.stack([scores / unit, np.ones(len(scores))])

    def loss(v: np.ndarray) -> float:
        z = v @ x
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * 0.01 * v[0] ** 2)

    v = np.array([1.0, 0.0])
    for _ in range(60):
        p = sigmoid(v @ x)
        gradient = x @ (p - target) + np.array([0.01 * v[0], 0])
        hessian = (x * (p * (1 - p))) @ x.T + np.diag([0.01, 1e-9])
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(max(v[0] / unit, 1e-6)), float(v[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
