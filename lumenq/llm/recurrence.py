"""Which keys recur elsewhere, found with one narrow shuffle.

A row is a key of 128 bits, a detail, and the place that holds it: doc_id and pos. Each
task sends on one row for a key and detail, its smallest place there, however many of
its places hold them; so no key meets more rows than there are tasks. The task's other
places of the key are known to be repeats, and go by their document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: key (first, second), detail, doc_id, pos
Keys = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: What a place asks of its key and detail: that another place has them; that a smaller
#: doc_id has them; the first of these, and whether the key has several details; or that it
#: is in the smallest of several documents.
EACH, LATER, SPLIT, OWNER = 0, 1, 2, 3
#: Bits of the answer.
REPEATED, IS_LATER, DIFFERS, OWNS = 1, 2, 4, 8
_WANTED = np.array([REPEATED, IS_LATER, REPEATED | DIFFERS, OWNS], np.int8)
#: Rows that a task holds before it sends them on.
HELD = 1 << 21
#: state: 0 speaks for one place, 1 for several of its task, 2 is a known repeat.
SENT = "first long, second long, detail long, doc_id long, pos long, kind byte, state byte"
_NAMES = ["first", "second", "detail", "doc_id", "pos", "kind", "state"]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _combined(parts: list[Keys], kind: int) -> Iterator[pa.RecordBatch]:
    first, second, detail, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, doc, detail, second, first))
    cols = [c[order] for c in (first, second, detail, doc, pos)]
    # one row for each place, or for each document where the smallest is sought
    fresh = _new(*cols[:4] if kind == OWNER else cols)
    cols = [c[fresh] for c in cols]
    speaks = _new(*cols[:3])
    size = np.diff(np.append(np.flatnonzero(speaks), len(speaks)))
    state = np.full(len(speaks), 2, np.int8)
    state[speaks] = size > 1
    if kind == OWNER:
        cols, state, speaks = [c[speaks] for c in cols], state[speaks], speaks[speaks]
    for i in range(0, len(speaks), 1 << 18):
        cut = slice(i, i + (1 << 18))
        n = len(state[cut])
        yield pa.RecordBatch.from_arrays([*(pa.array(c[cut]) for c in cols), pa.array(np.full(n, kind, np.int8)), pa.array(state[cut])], names=_NAMES)


def sender(kinds: Callable[[pa.RecordBatch], Iterator[tuple[int, Keys]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that finds keys of some kinds in its batches, and sends them combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Keys]] = {}
        count = 0
        for batch in batches:
            for kind, keys in kinds(batch):
                if len(keys[0]):
                    held.setdefault(kind, []).append(keys)
                    count += len(keys[0])
                if count > HELD:
                    for k, parts in held.items():
                        yield from _combined(parts, k)
                    held, count = {}, 0
        for k, parts in held.items():
            yield from _combined(parts, k)

    return run


def _judge(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    first, second, detail, doc, pos, kind, state = cols
    answer = np.full(len(first), REPEATED | IS_LATER, np.int8)
    at = np.flatnonzero(state < 2)
    if len(at):
        f, s, k, d, e, many = first[at], second[at], kind[at], detail[at], doc[at], state[at]
        key = _new(f, s, k)
        same = key | _new(d)
        begin = np.flatnonzero(same)
        size = np.diff(np.append(begin, len(at)))
        repeated = np.repeat((size > 1) | (np.maximum.reduceat(many, begin) > 0), size)
        later = e != np.repeat(e[begin], size)
        of_key = np.flatnonzero(key)
        details = np.repeat(np.add.reduceat(same.astype(np.int64), of_key), np.diff(np.append(of_key, len(at))))
        shared = np.repeat(np.logical_or.reduceat(later | (many > 0), of_key), np.diff(np.append(of_key, len(at))))
        answer[at] = repeated * REPEATED + later * IS_LATER + (details > 1) * DIFFERS + (key & shared) * OWNS
    hit = (answer & _WANTED[kind]) > 0
    if hit.any():
        yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (first, doc, pos, kind, answer)], names=["first", "doc_id", "pos", "kind", "answer"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to rows that are sorted by key, kind, detail and place."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in _NAMES]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        # what belongs to the last key waits for the next batch
        other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[5] != cols[5][-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        rest = [c[last:] for c in cols]
        if last:
            yield from _judge([c[:last] for c in cols])
    if rest is not None:
        yield from _judge(rest)


def recurring(sent: DataFrame) -> DataFrame:
    """first, doc_id, pos, kind, answer of the places whose key recurs as their kind asks."""
    route = F.when(F.col("state") == 2, F.xxhash64("doc_id")).otherwise(F.col("first"))
    met = sent.repartition(route).sortWithinPartitions("first", "second", "kind", "detail", "doc_id", "pos")
    return met.mapInArrow(_resolve, "first long, doc_id long, pos long, kind byte, answer byte")
