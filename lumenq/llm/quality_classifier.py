"""Quality classifier: naive Bayes support vectors.

Indicators of word 1-grams and 2-grams are scaled by each n-gram's log-count ratio
between the classes; a linear hinge-loss model is fitted to them by dual coordinate
descent, and its margin becomes a probability by a sigmoid fitted on rows that the
descent does not see.

Only rows whose crc32(doc_id as text) modulo 4 is not 2 are learnt from. A score
depends on the text alone. Null or empty text: no indicators, so the score is that of
the bias. Null doc_id: held_out is false, and the row is never learnt from. Repeated
rows: each is scored, and equal texts alike. Ties: a score of just PREDICT_FROM predicts
1. Very long texts: scored whole; of a labelled one at most labelled.MOST_SLOTS
indicators are learnt from. With no labels of both kinds the score is 0.5. Empty table:
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .labelled import fit_sigmoid, labelled_features, sigmoid
from .tables import documents, table

#: Labelled rows that the model is fitted on at most, a quarter of them for the sigmoid.
SAMPLE_ROWS = 4000
BITS = 20
COST = 1.0
EPOCHS = 20
PREDICT_FROM = 0.7


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    a: float
    b: float


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _indicators(chunk: H.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text's n-grams, and their text; ordered by text."""
    start, end, owner = chunk.words()
    hashes = H.word_hashes(chunk, start, end)
    at, pairs = H.windows(hashes, owner, 2)
    slot = np.concatenate([hashes, pairs]) >> H.U(64 - BITS)
    both = np.sort((np.concatenate([owner, owner[at]]).astype(H.U) << H.U(BITS)) | slot)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return (both & H.U((1 << BITS) - 1)).astype(np.int32), (both >> H.U(BITS)).astype(np.int64)


def _features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        slot, _ = _indicators(H.Chunk(np.zeros(1), [text]))
        out.append((slot, np.ones(len(slot), np.float32)))
    return out


def _unit(n: np.ndarray) -> np.ndarray:
    """Texts count alike, whatever their length."""
    return 1 / np.sqrt(np.maximum(n, 1))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model, or None unless at least four rows of each label are known."""
    x, y = labelled_features(docs, labels, "quality", rows, _features, usable=lambda doc_id: ~held_out(doc_id))
    x = [at for at, _ in x]
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return None
    order = np.random.default_rng(5).permutation(len(y))
    held, used = order[: len(y) // 4], order[len(y) // 4 :]
    if len(set(y[held].tolist())) < 2 or len(set(y[used].tolist())) < 2:
        held = used = order
    counts = [np.full(1 << BITS, 1.0), np.full(1 << BITS, 1.0)]
    for i in used:
        counts[y[i]][x[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias, sign = np.zeros(1 << BITS), 0.0, np.where(y == 1, 1.0, -1.0)
    unit = {i: float(_unit(np.array(len(x[i])))) for i in order}
    scale = {i: ratio[x[i]] * unit[i] for i in used}
    norm = {i: float(scale[i] @ scale[i]) + 1 for i in used}
    balance = {k: COST * len(used) / 2 / (y[used] == k).sum() for k in (0, 1)}
    alpha = dict.fromkeys(used.tolist(), 0.0)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(used).tolist():
            gradient = sign[i] * (w[x[i]] @ scale[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), balance[int(y[i])])
            if step := (new - alpha[i]) * sign[i]:
                w[x[i]] += step * scale[i]
                bias += step
                alpha[i] = new
    weight = (w * ratio).astype(np.float32)
    margin = np.array([weight[x[i]].sum() * unit[i] + bias for i in held])
    return Model(weight, bias, *fit_sigmoid(margin, y[held]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in H.chunks(batch.column("text__bytes").to_pylist()):
                n = len(chunk.texts)
                value = np.full(n, 0.5)
                if model is not None:
                    slot, text = _indicators(chunk)
                    margin = np.bincount(text, model.weight[slot], n) * _unit(np.bincount(text, minlength=n)) + model.bias
                    value = sigmoid(model.a * margin + model.b)
                part = batch.slice(int(chunk.rows[0]), n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(value), pa.array((value >= PREDICT_FROM).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text__bytes"))
    return narrow.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
