"""Substring dedup: words in windows that a document with a smaller id has too.

Windows are WINDOW consecutive words. Each is represented by its smallest 5-word hash, so
equal windows have equal anchors.

1. Only anchors (about a fifth of all positions) are shuffled to learn which are in two
   documents. A document whose whole text another with a smaller id has is known by that,
   and its windows aren't looked at.
2. Recurring passages are confirmed: windows over such anchors are compared by 128-bit
   hashes, and the smallest document of each that several have is its owner. Successive
   windows of an owner with one anchor are a passage: a row of word codes, once for the
   whole corpus.
3. Passages are dealt to shards by anchor, and compiled there to Aho-Corasick automata of
   at most SHARD_PATTERNS windows. All documents are streamed through them: the piece of
   a document around each anchor goes to that anchor's shard, and what the automaton
   finds there, and where, is what the document loses, if the owner's id is smaller.

A code is 15 bits of a word's hash, spelt as two letters, so that a state has few
successors; the 64 bits of the window's hash are held against each match. An anchor of over SPLIT_DOCS documents has its
pieces split over copies of its passages. The texts meet their lists by a shuffle, whose
files are deleted when a step is written.

Null text: no words. Null doc_id: kept whole, and no other text is held against it.
Rows that share a doc_id count as one document, and don't repeat each other; each of
them loses what any of them loses at that place. Repeated rows: the same. Ties: of equal
windows the smallest doc_id keeps its own. Texts under WINDOW words lose nothing. Very
long texts: whole; one over hashing.CHUNK_BYTES is handled alone. Empty table: empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from . import recurrence as R
from .tables import discard, documents, identified, settled

WINDOW = 13
ANCHOR = 5
#: Windows in one automaton, at most, and pieces of a shard, about.
SHARD_PATTERNS, SHARD_PIECES = 20_000, 50_000
#: Documents whose pieces of one anchor go to one task.
SPLIT_DOCS = 10_000
PIECE = "anchor long, doc_id long, split int, start long, codes binary, checks binary"


def _anchors(hashes: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, the smallest phrase hash in it, and whether each phrase is one."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, H.U), np.empty(0, bool)
    every = np.arange(len(hashes) - ANCHOR + 1)
    phrase = H.ranges_hash(hashes, every, every + ANCHOR, 1)
    least = phrase[:n].copy()
    for j in range(1, window - ANCHOR + 1):
        np.minimum(least, phrase[j : n + j], out=least)
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    return at, least[at], phrase


def _text_hash(hashes: np.ndarray, chunk: H.Chunk, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = chunk.first(owner)
    return tuple(H.as_long(H.ranges_hash(hashes, first[:-1], first[1:], which)) for which in (1, 2))


def _find_anchors(window: int):
    def find(batch: pa.RecordBatch) -> Iterator[tuple[int, R.Keys]]:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for chunk in H.chunks(batch.column("text").to_pylist()):
            start, end, owner = chunk.words()
            hashes = H.word_hashes(chunk, start, end)
            doc = ids[chunk.rows[0] : chunk.rows[-1] + 1]
            at, least, _ = _anchors(hashes, owner, window)
            # one row for each anchor of a document
            own = H.mix(least ^ (owner[at].astype(H.U) * H.U(0x9E3779B97F4A7C15)))
            _, once = np.unique(own, return_index=True)
            zero = np.zeros(len(once), np.int64)
            yield R.EACH, (H.as_long(least[once]), zero, zero, doc[owner[at[once]]], zero)
            long = np.flatnonzero(np.bincount(owner, minlength=len(doc)) >= window)
            a, b = _text_hash(hashes, chunk, owner)
            yield R.LATER, (a[long], b[long], 0 * long, doc[long], 0 * long)

    return find


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and their rows."""
    lists = lists.fill_null(pa.scalar([], lists.type))
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _find_windows(window: int):
    def find(batch: pa.RecordBatch) -> Iterator[tuple[int, R.Keys]]:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        known = np.unique(_flat(batch.column("anchors"))[0])
        for chunk in H.chunks(batch.column("text").to_pylist()):
            start, end, owner = chunk.words()
            hashes = H.word_hashes(chunk, start, end)
            at, least, _ = _anchors(hashes, owner, window)
            at = at[_member(H.as_long(least), known)]
            if len(at):
                doc = ids[chunk.rows[0] : chunk.rows[-1] + 1]
                a, b = (H.as_long(H.ranges_hash(hashes, at, at + window, which)) for which in (1, 2))
                yield R.OWNER, (a, b, 0 * at, doc[owner[at]], at - chunk.first(owner)[owner[at]])

    return find


def _binary(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """A column of runs of numbers."""
    ends = np.concatenate([[0], np.cumsum(size * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _pieces(window: int):
    """The pieces around anchors: of windows that are owned, where the batch has a column of their places, else of all windows with its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            if owned := "owned" in batch.schema.names:
                places, row = _flat(batch.column("owned"))
            else:
                known = np.unique(_flat(batch.column("anchors"))[0])
                hot, once = np.unique(_flat(batch.column("hot"))[0], return_index=True)
                splits = _flat(batch.column("splits"))[0][once]
            for chunk in H.chunks(batch.column("text").to_pylist()):
                start, end, owner = chunk.words()
                hashes = H.word_hashes(chunk, start, end)
                at, least, _ = _anchors(hashes, owner, window)
                first = chunk.first(owner)
                if owned:
                    mine = (row >= chunk.rows[0]) & (row <= chunk.rows[-1])
                    use = _member(at, np.unique(places[mine] + first[row[mine] - chunk.rows[0]]))
                else:
                    use = _member(H.as_long(least), known)
                at, least = at[use], least[use]
                if not len(at):
                    continue
                begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (least[1:] != least[:-1])]))
                many = np.diff(np.append(begin, len(at)))
                size = many + window - 1
                inside = np.repeat(at[begin] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                anchor, text = H.as_long(least[begin]), owner[at[begin]]
                doc = ids[chunk.rows[0] + text]
                split = np.zeros(len(begin), np.int32)
                if not owned and len(hot):
                    is_hot = _member(anchor, hot)
                    spread = H.mix(doc[is_hot].astype(H.U)) % splits[np.searchsorted(hot, anchor[is_hot])].astype(H.U)
                    split[is_hot] = spread.astype(np.int32)
                codes = (hashes >> H.U(49)).astype(_CODE) + _CODE.type(1)
                check = H.ranges_hash(hashes, at, at + window, 1)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor, doc, split, at[begin] - first[text])), _binary(codes[inside], size), _binary(check, many)], names=["anchor", "doc_id", "split", "start", "codes", "checks"])

    return run


#: Codes are from 1 on; as bytes they are two letters each.
_CODE = np.dtype("<u2")


def _numbers(column: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of _binary(), and how many each row has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.fromiter(map(len, parts), np.int64, len(parts)) // kind.itemsize


class Windows:
    """The windows of a shard's passages, as patterns: owner and check of each, and others of the same codes."""

    def __init__(self, passages: pa.Table, window: int):
        codes, size = _numbers(passages.column("codes"), _CODE)
        checks, many = _numbers(passages.column("checks"), np.dtype(H.U))
        owner = np.repeat(passages.column("doc_id").to_numpy(), many)
        at = np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(len(checks))
        letters, first = codes.tobytes().decode("latin-1"), {}
        keys, self.twins = [], []
        for k, p in enumerate(at.tolist()):
            key = letters[2 * p : 2 * (p + window)]
            if (same := first.setdefault(key, k)) == k:
                keys.append((key, k))
            else:
                self.twins.append((same, k))
        self.keys, self.owner, self.check = keys, owner, checks

    def automata(self) -> Iterator:
        import ahocorasick

        for i in range(0, len(self.keys), SHARD_PATTERNS):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for key, k in self.keys[i : i + SHARD_PATTERNS]:
                automaton.add_word(key, k)
            automaton.make_automaton()
            yield automaton


def _locate(window: int):
    """What each piece loses: its document, and first window and number of windows of each run."""

    def run(pieces: pa.Table, passages: pa.Table) -> pa.Table:
        found = {"doc_id": pa.array([], pa.int64()), "lost": pa.array([], pa.int64())}
        if not pieces.num_rows or not passages.num_rows:
            return pa.table(found)
        known = Windows(passages, window)
        codes, size = _numbers(pieces.column("codes"), _CODE)
        checks, many = _numbers(pieces.column("checks"), np.dtype(H.U))
        # pieces follow each other with a 0 between, which no pattern has
        begin = np.cumsum(size + 1) - size - 1
        joined = np.zeros(int((size + 1).sum()), _CODE)
        joined[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(codes))] = codes
        letters = joined.tobytes().decode("latin-1")
        hits = [hit for automaton in known.automata() for hit in automaton.iter(letters)]
        if not hits:
            return pa.table(found)
        place, pattern = np.array(hits, np.int64).T
        whole = place % 2 == 1
        place, pattern = place[whole] // 2, pattern[whole]
        for same, other in known.twins:
            place, pattern = np.append(place, place[pattern == same]), np.append(pattern, np.full((pattern == same).sum(), other))
        place -= window - 1
        piece = np.searchsorted(begin, place, "right") - 1
        number = np.cumsum(many)[piece] - many[piece] + place - begin[piece]
        docs = pieces.column("doc_id").to_numpy()
        good = (checks[number] == known.check[pattern]) & (known.owner[pattern] < docs[piece])
        number = np.unique(number[good])
        piece = np.searchsorted(np.cumsum(many), number, "right")
        start = pieces.column("start").to_numpy()[piece] + number - (np.cumsum(many) - many)[piece]
        # a run ends where the next window isn't lost, with its piece, and at the latest after _MOST_RUN windows
        fresh = np.concatenate([np.ones(min(1, len(number)), bool), (np.diff(number) != 1) | (np.diff(piece) != 0)])
        since = np.arange(len(number)) - np.maximum.accumulate(np.where(fresh, np.arange(len(number)), 0))
        edge = np.flatnonzero(fresh | (since % _MOST_RUN == 0))
        run_of = np.diff(np.append(edge, len(number)))
        return pa.table({"doc_id": pa.array(docs[piece[edge]]), "lost": pa.array((start[edge] << 16) + run_of)})

    return run


#: Windows that one entry of what a document loses may have.
_MOST_RUN = (1 << 16) - 1


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = batch.column("copy").to_numpy(zero_copy_only=False)
            lost, row = _flat(batch.column("lost"))
            for chunk in H.chunks(batch.column("text").to_pylist()):
                n, low = len(chunk.rows), int(chunk.rows[0])
                _, _, owner = chunk.words()
                size = np.bincount(owner, minlength=n)
                bounds = chunk.first(owner)
                mine = (row >= low) & (row < low + n)
                text, v = row[mine] - low, lost[mine]
                begin, end = v >> 16, (v >> 16) + (v & _MOST_RUN) + window - 1
                # a place of another text with this doc_id may lie outside
                good = end <= size[text]
                change = np.zeros(len(owner) + 1, np.int64)
                np.add.at(change, (begin + bounds[text])[good], 1)
                np.add.at(change, (end + bounds[text])[good], -1)
                gone = np.cumsum(change[:-1]) > 0
                gone |= (copy[low : low + n] & (size >= window))[owner]
                removed = np.bincount(owner[gone], minlength=n)
                kept = []
                for i, t in enumerate(chunk.texts):
                    words = t.split()
                    if removed[i]:
                        words = list(compress(words, ~gone[bounds[i] : bounds[i + 1]]))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, n), pa.array(size), pa.array(removed), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def passages(known: DataFrame, some: DataFrame, window: int) -> DataFrame:
    """anchor, doc_id, codes and checks of the passages that several documents have, in the smallest of these."""
    windows = R.recurring(known.join(some, "doc_id").mapInArrow(R.sender(_find_windows(window)), R.SENT))
    owned = settled(windows.groupBy("doc_id").agg(F.collect_list("pos").alias("owned")))
    out = settled(known.join(owned, "doc_id").mapInArrow(_pieces(window), PIECE).select("anchor", "doc_id", "codes", "checks"))
    discard(owned)
    return out


def located(known: DataFrame, held: DataFrame, confirmed: DataFrame, window: int) -> DataFrame:
    """doc_id and lost, the runs of windows that the automata find in each document.

    held: anchor and doc_id of the anchors that documents may share. confirmed: the passages.
    """
    met = settled(held.join(confirmed.select("anchor").distinct(), "anchor", "left_semi"))
    n_pieces, n_windows = met.count(), confirmed.agg(F.coalesce(F.sum(F.octet_length("checks")), F.lit(0))).first()[0] // 8
    # three quarters full on average, so that few need a second automaton
    shards = max(1, -(-n_pieces // SHARD_PIECES), -(-4 * n_windows // (3 * SHARD_PATTERNS)))
    splits = F.ceil(F.count(F.lit(1)) / SPLIT_DOCS).cast("int")
    hot = settled(met.groupBy("anchor").agg(splits.alias("splits")).where("splits > 1"))
    lists = met.join(hot, "anchor", "left").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("splits") > 1, F.col("anchor"))).alias("hot"), F.collect_list("splits").alias("splits"))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    pieces = known.join(lists, "doc_id").mapInArrow(_pieces(window), PIECE).select(shard, "split", "doc_id", "start", "codes", "checks")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)).alias("split")
    dealt = confirmed.join(hot, "anchor", "left").select(shard, each, "doc_id", "codes", "checks")
    found = pieces.groupBy("shard", "split").cogroup(dealt.groupBy("shard", "split")).applyInArrow(_locate(window), "doc_id long, lost long")
    out = settled(found.groupBy("doc_id").agg(F.collect_list("lost").alias("lost")))
    discard(met, hot)
    return out


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces, as UTF-8)."""
    docs = identified(docs)
    known = docs.where("doc_id is not null")
    anchors = settled(R.recurring(known.mapInArrow(R.sender(_find_anchors(window)), R.SENT)).select("kind", F.col("first").alias("anchor"), "doc_id").distinct())
    copies = settled(anchors.where(F.col("kind") == R.LATER).select("doc_id").distinct())
    held = settled(anchors.where(F.col("kind") == R.EACH).select("anchor", "doc_id").join(copies, "doc_id", "left_anti"))
    discard(anchors)
    some = settled(held.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")))
    confirmed = passages(known, some, window)
    lost = located(known, held, confirmed, window)
    discard(some, held, confirmed)
    both = known.join(copies.withColumn("copy", F.lit(True)), "doc_id", "left").join(lost, "doc_id", "left")
    others = docs.where("doc_id is null").withColumns({"copy": F.lit(False), "lost": F.lit(None).cast("array<long>")})
    whole = both.withColumn("copy", F.coalesce("copy", F.lit(False))).unionByName(others)
    return whole.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
