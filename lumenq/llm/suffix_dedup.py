"""Suffix dedup: bytes of strings of LENGTH bytes that start elsewhere too.

Prefix doubling sorts (rank, rank) pairs of positions at growing offsets, drops those whose
new rank is unique, and stops past the threshold. Over every byte that sorts many times
the input, so it runs here over a sparse set of positions, which lose no string:

1. Each string of LENGTH bytes is represented by the smallest hash of SEED bytes in it,
   its anchor; equal strings have equal anchors at equal offsets. Anchors are about one
   in 180 bytes. Spark sorts (hash, place) and drops the unique ones.
2. The strings of an anchor start t bytes before it. They are taken in runs of LEAF
   successive t. A run has a core, the CORE bytes that all its strings share. The
   positions that are ranked are the first bytes of the cores. Each round ranks prefixes
   of the core twice as long, PREFIXES in turn: Spark sorts the pair of the ranks of both
   halves, (rank at the position, rank at the offset), with the place, and drops unique
   pairs. The last round ranks whole cores; where one is unique, so is every string.
3. A run also has a whole, all bytes that any of its strings has. Where the whole of a
   repeated core recurs, so does every string. Where a core has several wholes, strings
   are sorted one by one by the pair of hashes of all their LENGTH bytes.

A rank is a 64-bit hash of the bytes it stands for, so the rank at an offset is read from
prefix sums over the text and needs no join by position. The texts meet each round's
list of positions by a shuffle, whose files are deleted when the round is written.

Null text: empty. Texts under LENGTH bytes lose nothing. Null doc_id: kept whole, and
nothing is held against it. Rows that share a doc_id and text are one document; rows
that share a doc_id with other texts lose what any of them loses at that place. Ties:
all occurrences go, so there is nothing to choose. Very long texts: whole; a text over
hashing.CHUNK_BYTES is handled alone. Empty table: empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from . import recurrence as R
from .tables import discard, documents, identified, settled

LENGTH = 400
SEED = 32
LEAF = 41
#: Bytes that all strings of a run share, and the prefixes of them that rounds rank.
CORE = LENGTH - LEAF + 1
PREFIXES = (CORE // 4, CORE // 2, CORE)
#: pos of a run is the anchor's place times this, plus the number of the run
_RUNS = 16


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over each width successive values, in log2(width) steps."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


class Anchors:
    """The anchors of a chunk's strings: place, hash, text, and the first and last string that each represents."""

    def __init__(self, chunk: H.Chunk):
        none = np.empty(0, np.int64)
        self.place = self.text = self.low = self.high = none
        self.hash = none
        n = len(chunk.data) - LENGTH + 1
        if n <= 0:
            return
        self.values = H.byte_values(chunk.data)
        every = np.arange(len(chunk.data) - SEED + 1)
        seeds = H.ranges_hash(self.values, every, every + SEED, 0)
        width = LENGTH - SEED + 1
        least = _sliding(seeds, width, np.minimum)
        text = np.repeat(np.arange(len(chunk.texts)), chunk.size + 1)
        start = np.flatnonzero(chunk.end[text[:n]] >= np.arange(n) + LENGTH)
        if not len(start):
            return
        # the first place of the smallest hash from each start: walk over the places that are smallest for any
        value = least[start]
        chosen = np.zeros(len(seeds), bool)
        top = np.zeros(len(seeds) + width - 1, H.U)
        top[start + width - 1] = value
        chosen = _sliding(top, width, np.maximum)[: len(seeds)] == seeds
        places = np.flatnonzero(chosen)
        at = np.searchsorted(places, start)
        wrong = np.flatnonzero(seeds[places[at]] != value)
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[seeds[places[at[wrong]]] != value[wrong]]
        place = places[at]
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        self.place, self.low = place[new], start[new]
        self.high = start[np.append(new[1:], len(place)) - 1]
        self.hash, self.text = H.as_long(seeds[self.place]), text[self.place]


def _find_anchors(batch: pa.RecordBatch) -> Iterator[tuple[int, R.Keys]]:
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for chunk in H.chunks(batch.column("text").to_pylist()):
        a = Anchors(chunk)
        zero = 0 * a.place
        yield R.EACH, (a.hash, zero, zero, ids[chunk.rows[0] + a.text], a.place - chunk.begin[a.text])


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and their rows."""
    lists = lists.fill_null(pa.scalar([], lists.type))
    size = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), size)


def _pairs(values: np.ndarray, core: np.ndarray, length: int) -> list[np.ndarray]:
    """The ranks of both halves of the prefixes of some cores."""
    half = core + length // 2
    return [H.as_long(H.ranges_hash(values, low, high, 1)) for low, high in ((core, half), (half, core + length))]


def _first_round(batch: pa.RecordBatch) -> Iterator[tuple[int, R.Keys]]:
    """Runs of the known anchors, by the shortest prefix of their core."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    known = np.unique(_flat(batch.column("anchors"))[0])
    for chunk in H.chunks(batch.column("text").to_pylist()):
        a = Anchors(chunk)
        use = np.flatnonzero(_member(a.hash, known))
        if not len(use):
            continue
        from_run = (a.place - a.high)[use] // LEAF
        n = (a.place - a.low)[use] // LEAF - from_run + 1
        anchor = np.repeat(use, n)
        run = np.repeat(from_run, n) + np.arange(len(anchor)) - np.repeat(np.cumsum(n) - n, n)
        place, text = a.place[anchor], a.text[anchor]
        one, two = _pairs(a.values, place - run * LEAF, PREFIXES[0])
        yield R.EACH, (one, two, 0 * run, ids[chunk.rows[0] + text], (place - chunk.begin[text]) * _RUNS + run)


def _next_round(length: int):
    """Runs that are left, by a prefix of this length; the last round also holds their wholes against each other."""

    def find(batch: pa.RecordBatch) -> Iterator[tuple[int, R.Keys]]:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        all_pos, row = _flat(batch.column("left"))
        for chunk in H.chunks(batch.column("text").to_pylist()):
            mine = (row >= chunk.rows[0]) & (row <= chunk.rows[-1])
            pos, text = all_pos[mine], row[mine] - chunk.rows[0]
            place, near = pos // _RUNS + chunk.begin[text], pos % _RUNS * LEAF
            # a place of another text with this doc_id may lie outside
            good = (place - near >= chunk.begin[text]) & (place - near + CORE <= chunk.end[text])
            pos, text, place, near = pos[good], text[good], place[good], near[good]
            if not len(pos):
                continue
            values, doc = H.byte_values(chunk.data), ids[chunk.rows[0] + text]
            one, two = _pairs(values, place - near, length)
            if length < CORE:
                yield R.EACH, (one, two, 0 * pos, doc, pos)
                continue
            begin, end = place - near - LEAF + 1, place - near + LENGTH
            inside = (begin >= chunk.begin[text]) & (end <= chunk.end[text])
            # a whole that the text cuts short is like no other
            alone = H.as_long(H.mix(H.mix(doc.astype(H.U)) + pos.astype(H.U)))
            whole = np.where(inside, H.as_long(H.ranges_hash(values, np.where(inside, begin, 0), np.where(inside, end, 0), 1)), alone)
            yield R.SPLIT, (one, two, whole, doc, pos)

    return find


def _find_strings(batch: pa.RecordBatch) -> Iterator[tuple[int, R.Keys]]:
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    pos, row = _flat(batch.column("open"))
    for chunk in H.chunks(batch.column("text").to_pylist()):
        mine = (row >= chunk.rows[0]) & (row <= chunk.rows[-1])
        if not mine.any() or len(chunk.data) < LENGTH:
            continue
        text = row[mine] - chunk.rows[0]
        place, run = pos[mine] // _RUNS + chunk.begin[text], pos[mine] % _RUNS
        start = (place - run * LEAF)[:, None] - np.arange(LEAF)
        text = np.broadcast_to(text[:, None], start.shape)
        good = (start >= chunk.begin[text]) & (start + LENGTH <= chunk.end[text])
        start, text = start[good], text[good]
        start, once = np.unique(start, return_index=True)
        text = text[once]
        values = H.byte_values(chunk.data)
        a, b = (H.as_long(H.ranges_hash(values, start, start + LENGTH, w)) for w in (1, 2))
        yield R.EACH, (a, b, 0 * start, ids[chunk.rows[0] + text], start - chunk.begin[text])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, run_row = _flat(batch.column("full"))
        starts, start_row = _flat(batch.column("starts"))
        for chunk in H.chunks(batch.column("text").to_pylist()):
            low, n = int(chunk.rows[0]), len(chunk.rows)
            change = np.zeros(len(chunk.data) + 1, np.int64)
            for value, row, is_run in ((runs, run_row, True), (starts, start_row, False)):
                mine = (row >= low) & (row < low + n)
                text, v = row[mine] - low, value[mine]
                near = v % _RUNS * LEAF if is_run else 0
                begin = v // _RUNS - near - LEAF + 1 if is_run else v
                end = v // _RUNS - near + LENGTH if is_run else v + LENGTH
                good = (begin >= 0) & (end <= chunk.size[text])
                np.add.at(change, (begin + chunk.begin[text])[good], 1)
                np.add.at(change, (end + chunk.begin[text])[good], -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = chunk.per_text(gone)
            spans = chunk.per_text(gone & ~np.append(False, gone[:-1]))
            kept = []
            for i, text in enumerate(chunk.texts):
                stays = ~gone[chunk.begin[i] : chunk.end[i]] if removed[i] else None
                kept.append(text if stays is None else chunk.data[chunk.begin[i] : chunk.end[i]][stays].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, n), pa.array(chunk.size), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _left(ranked: DataFrame) -> DataFrame:
    """The places of each document whose rank isn't unique."""
    return settled(ranked.groupBy("doc_id").agg(F.collect_list("pos").alias("left")))


def _judged(ranked: DataFrame) -> DataFrame:
    """full: the runs of each document whose strings all recur. open: those whose core has several wholes."""
    when = lambda bit: F.collect_list(F.when(F.col("answer").bitwiseAND(bit) > 0, F.col("pos")))
    return settled(ranked.groupBy("doc_id").agg(when(R.REPEATED).alias("full"), when(R.DIFFERS).alias("open")))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    docs = identified(docs)
    known = docs.where("doc_id is not null")
    long = known.where(f"octet_length(text) >= {LENGTH}")
    anchors = settled(R.recurring(long.mapInArrow(R.sender(_find_anchors), R.SENT)).groupBy("doc_id").agg(F.collect_set("first").alias("anchors")))
    left = _left(R.recurring(long.join(anchors, "doc_id").mapInArrow(R.sender(_first_round), R.SENT)))
    discard(anchors)
    for length in PREFIXES[1:]:
        before = left
        ranked = R.recurring(long.join(before, "doc_id").mapInArrow(R.sender(_next_round(length)), R.SENT))
        left = _left(ranked) if length < CORE else _judged(ranked)
        discard(before)
    judged = left
    open_runs = judged.where("size(open) > 0").select("doc_id", "open")
    strings = R.recurring(long.join(open_runs, "doc_id").mapInArrow(R.sender(_find_strings), R.SENT))
    starts = settled(strings.groupBy("doc_id").agg(F.collect_list("pos").alias("starts")))
    lists = known.join(judged.drop("open"), "doc_id", "left").join(starts, "doc_id", "left")
    others = docs.where("doc_id is null").withColumns({"full": F.lit(None).cast("array<long>"), "starts": F.lit(None).cast("array<long>")})
    return lists.unionByName(others).mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
