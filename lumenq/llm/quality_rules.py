"""Quality rules: text counts, then a calibrated logistic regression over hashed
word and character n-grams against a fixed threshold.

A text fails the base rules with under 10 words, or when over a fifth of its words
are in 5-word windows that it holds twice or more. What passes is kept when the
regression, trained on labelled rows, gives it at least KEEP_FROM as the calibrated
probability of label 1.

Null text: no words, so it fails. Null doc_id: handled as any row, and never learnt
from. Repeated rows: each is judged for itself. Ties: a probability of just KEEP_FROM
keeps. Very long texts: judged whole; of a labelled one at most labelled.MOST_SLOTS n-grams are
learnt from. Without labels of both kinds no model can be fitted, and the base rules
alone decide. Empty table: empty result. Extra columns are ignored by measure() and kept
by keep(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import hashing as H
from .labelled import fit_sigmoid, labelled_features, sigmoid
from .tables import documents, table

#: Labelled rows that the model is fitted on at most, a quarter of them to calibrate it.
SAMPLE_ROWS = 2000
#: Probability of label 1 from which a text is kept.
KEEP_FROM = 0.3
MIN_WORDS = 10
WINDOW = 5
BITS = 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


@dataclass
class Model:
    """Weights of word 1-grams, word 2-grams and runs of 3 characters."""

    weight: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0


def _slot(h: np.ndarray, family: int) -> np.ndarray:
    return (h >> H.U(64 - BITS)).astype(np.int64) + (family << BITS)


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and value, made of its bytes, of each character of UTF-8."""
    first = (data & 0xC0) != 0x80
    start = np.flatnonzero(first)
    value = data[start].astype(np.uint32)
    more = np.ones(len(start), bool)
    for k in range(1, 4):
        at = np.minimum(start + k, len(data) - 1)
        more &= (start + k < len(data)) & ~first[at]
        value = np.where(more, (value << np.uint32(8)) | data[at], value)
    return start, value


def _counted(chunk: H.Chunk, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct n-grams: text, slot, and the root of the n-gram's share of its family."""
    n = len(chunk.texts)
    at, pairs = H.windows(hashes, owner, 2)
    start, character = _characters(chunk.data)
    code = np.zeros(max(0, len(character) - 2), np.uint32)
    for k in range(3):
        code = (code + character[k : len(code) + k] + np.uint32(1)) * np.uint32(0x9E3779B1)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    place = np.searchsorted(chunk.end, start[: len(code)])
    # a run ends in its text if its third character does
    inside = start[2:] < chunk.end[place]
    slots = [_slot(hashes, 0), _slot(pairs, 1), (code[inside] >> np.uint32(32 - BITS)).astype(np.int64) + (2 << BITS)]
    owners = [owner, owner[at], place[inside]]
    total = np.concatenate([np.maximum(np.bincount(o, minlength=n), 1) for o in owners])
    both = np.sort((np.concatenate(owners) << (BITS + 2)) | np.concatenate(slots))
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(both)), bool), both[1:] != both[:-1]]))
    count = np.diff(np.append(first, len(both)))
    text, slot = both[first] >> (BITS + 2), both[first] & ((4 << BITS) - 1)
    return text, slot, np.sqrt(count / total[(slot >> BITS) * n + text]).astype(np.float32)


def _features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        chunk = H.Chunk(np.zeros(1), [text])
        start, end, owner = chunk.words()
        _, slot, value = _counted(chunk, H.word_hashes(chunk, start, end), owner)
        out.append((slot.astype(np.int32), value))
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model, or None unless at least four rows of each label are known."""
    x, y = labelled_features(docs, labels, "quality", rows, _features)
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return None
    order = np.random.default_rng(11).permutation(len(y))
    held, used = order[: len(y) // 4], order[len(y) // 4 :]
    weight, seen, bias = np.zeros(3 << BITS, np.float32), np.full(3 << BITS, 1e-8, np.float32), 0.0
    balance = {k: len(used) / 2 / max(1, (y[used] == k).sum()) for k in (0, 1)}
    for epoch in range(12):
        rate = 0.1 / (1 + epoch / 4)
        for i in np.random.default_rng(epoch).permutation(used):
            at, value = x[i]
            p = float(sigmoid(np.float64(weight[at] @ value + bias)))
            slope = (p - y[i]) * balance[int(y[i])]
            gradient = slope * value + 1e-6 * weight[at]
            seen[at] += gradient * gradient
            weight[at] -= rate * gradient / np.sqrt(seen[at])
            bias -= 0.02 * slope
    score = np.array([weight[x[i][0]] @ x[i][1] + bias for i in held])
    # the features lie in Arrow's memory, which otherwise stays with the driver's process
    del x, at, value
    pa.default_memory_pool().release_unused()
    if len(set(y[held].tolist())) < 2:
        return Model(weight, bias)
    return Model(weight, bias, *fit_sigmoid(score, y[held]))


def _measure(chunk: H.Chunk, model: Model | None) -> dict[str, np.ndarray]:
    n = len(chunk.texts)
    start, end, owner = chunk.words()
    hashes = H.word_hashes(chunk, start, end)
    words = np.bincount(owner, minlength=n)
    at, h = H.windows(hashes, owner, WINDOW)
    own = H.mix(h ^ (owner[at].astype(H.U) * H.U(0x9E3779B97F4A7C15)))
    inside = H.covered(at[H.repeated(own)], WINDOW, len(hashes))
    repeat = np.bincount(owner[inside], minlength=n)
    doubled = np.zeros(n, np.int64)
    for i, text in enumerate(chunk.texts):
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
        doubled[i] = len(lines) - len(set(lines))
    failed = (words < MIN_WORDS) | (100 * repeat > 20 * words)
    kept = ~failed
    if model is not None:
        text, slot, value = _counted(chunk, hashes, owner)
        score = np.bincount(text, model.weight[slot] * value, n) + model.bias
        kept &= sigmoid(model.a * score + model.b) >= KEEP_FROM
    return {
        "n_words": words,
        "word_chars": chunk.per_text(~H.SEPARATOR[chunk.data] & ((chunk.data & 0xC0) != 0x80)),
        "n_symbols": chunk.per_text(_SYMBOL[chunk.data]),
        "n_dup_lines": doubled,
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": kept,
    }


def _judged(model: Model | None, keep: tuple[str, ...], only_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in H.chunks(batch.column("text").cast(pa.binary()).to_pylist()):
                found = _measure(chunk, model)
                part = batch.slice(int(chunk.rows[0]), len(chunk.rows))
                columns = [part.column(c) for c in keep]
                if only_kept:
                    yield pa.RecordBatch.from_arrays(columns, names=list(keep)).filter(pa.array(found["kept"]))
                else:
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(v) for v in found.values()], names=[*keep, *found])

    return run


def measure(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, the counts, base_failed and kept, for each row."""
    return docs.select("doc_id", "text").mapInArrow(_judged(model, ("doc_id",), False), "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", " + SCHEMA)


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    names = tuple(docs.columns)
    return docs.mapInArrow(_judged(model, names, True), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return measure(docs, fit(docs, table(spark, sf_dir, "labels")))
