"""Near-duplicate groups by bottom-k sketches.

A document's set is its distinct word shingles. Documents with equal sets form a class,
which its smallest doc_id stands for. A class' sketch is the K smallest values of one
hash over its set; a set of up to K shingles is its own sketch.

Inverted lists over the first RETAINED sketch values give candidates. Two sets of
similarity s miss each other in m values with chance (1 - s)**m.
 - Lists of up to LIST classes are cold. Pairs that share one of the first COLD cold values
   of both are candidates.
 - A class with fewer cold values, or of whose retained values a third is common, is dense,
   as in a large group of near copies. Cold values of its own don't count against it, as
   nobody shares them. Only dense classes meet in the other lists. Again lists of
   up to LIST of them give pairs. In longer ones all meet the list's hub, its class of the
   most common values. Classes that prove too far from a hub for a link are compared with
   all that met it, in blocks, by their full sets, and a block returns a link only where
   it joins two groups.
Other candidates are estimated from the bottom k of their joint sketch, and what is left
is confirmed by exact similarity over full sets. Links then spread by components().

Joins of pairs, of representatives and of blocks are hinted as merge joins: their files
are small when compressed, and estimates leave out what explode makes, so that a plan
would broadcast them through the driver however many rows they have.

So no list emits all its pairs unless it is short, and copies within reach of a hub cost
a row each. What stays quadratic is dense classes out of reach of their hub, against
that hub's members.

Null, empty or wordless text: an empty set, linked with nothing. Null doc_id: a group of
its own, component_id null. Rows that share a doc_id: one group; if their sets differ,
the lists hold the largest. Repeated rows: one group. Ties: similarity of just the
threshold is a link, and the smallest doc_id stands for a group. Very long texts: whole
sets; their sketch is no larger. Empty table: empty result. Extra columns are ignored by
groups() and kept by keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hashing as H
from .components import components
from .tables import discard, documents, identified, settled, unused

K = 128
RETAINED = 24
COLD = 10
LIST = 32
#: Common values of RETAINED that make a class dense, whatever its other values are: a member of
#: similarity 0.8 has fewer with the chance of 17 misses of 24, 1e-7.
DENSE = 8
#: Rows and shingles of a block of the comparison with a hub's members, about, and shingles compared at once.
BLOCK, BLOCK_SHINGLES, SLICE = 512, 1 << 20, 8192
#: What an estimate of a sketch of K may be too small by: over four standard errors.
SLACK = 0.16


def _sets(chunk: H.Chunk, words: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    start, end, owner = chunk.words()
    hashes = H.word_hashes(chunk, start, end)
    at, h = H.windows(hashes, owner, words)
    first, cut = chunk.first(owner), chunk.first(owner[at])
    for i in range(len(chunk.texts)):
        n = first[i + 1] - first[i]
        if n == 0:
            yield np.empty(0, H.U)
        elif n < words:
            yield H.ranges_hash(hashes[first[i] : first[i + 1]], np.array([0]), np.array([n]))
        else:
            yield np.unique(h[cut[i] : cut[i + 1]])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in H.chunks(batch.column("text").to_pylist(), lower=True):
                n, one, two, head, rest = [], [], [], [], []
                for s in _sets(chunk, words):
                    n.append(len(s))
                    one.append(int(H.as_long(H.mix(s).sum(keepdims=True))[0]) if len(s) else 0)
                    two.append(int(H.as_long(H.mix(s ^ H.U(0x5851F42D4C957F2D)).sum(keepdims=True))[0]) if len(s) else 0)
                    head.append(H.as_long(s[:RETAINED]))
                    rest.append(H.as_long(s[RETAINED:K]))
                ids = batch.column("doc_id").slice(int(chunk.rows[0]), len(chunk.rows))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n, one, two)), _lists(head), _lists(rest)], names=["doc_id", "n", "one", "two", "head", "rest"])

    return run


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the set), one and two (128 bits of the whole set), and the sketch:
    head, the RETAINED values that lists hold, and rest."""
    return docs.mapInArrow(_sketch(words), "doc_id long, n long, one long, two long, head array<long>, rest array<long>")


def _pairs(lists: DataFrame, ratio: float) -> DataFrame:
    """a, b and how many lists hold both; lists: value, doc_id, n, each list short."""
    held = lists.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n"))).alias("held")).where(F.size("held") > 1)
    left = held.select("held", F.posexplode("held").alias("i", "x"))
    both = left.select("x", F.explode(F.slice(F.col("held"), F.col("i") + 2, F.lit(LIST))).alias("y"))
    both = both.where(F.least("x.n", "y.n") >= ratio * F.greatest("x.n", "y.n") - 1e-9)
    return both.groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def _filter(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            sa, sb = batch.column("sa"), batch.column("sb")
            order = lambda s: np.sort(s.values.to_numpy(zero_copy_only=False).view(H.U)).astype(H.U)
            keep = []
            for i in range(batch.num_rows):
                exact = na[i] <= K and nb[i] <= K
                a, b = order(sa[i]), order(sb[i])
                edge = [s[-1] if n > len(s) else H.U(2**64 - 1) for s, n in ((a, na[i]), (b, nb[i]))]
                a, b = a[a <= min(edge)], b[b <= min(edge)]
                shared = len(np.intersect1d(a, b, assume_unique=True))
                union = max(1, len(a) + len(b) - shared)
                keep.append(shared >= threshold * union - 1e-9 if exact else shared >= (threshold - SLACK) * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(pairs: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs whose joint sketch leaves the threshold possible."""
    side = lambda x: sketched.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.concat("head", "rest").alias(f"s{x}"))
    return pairs.select("a", "b").hint("merge").join(side("a"), "a").join(side("b"), "b").mapInArrow(_filter(threshold), "a long, b long")


def _exact(words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                s, t = _sets(H.Chunk(np.zeros(2), [x or b"", y or b""], lower=True), words)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * shared >= round(100 * threshold) * (len(s) + len(t) - shared) and len(s) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.hint("merge").join(side("a"), "a").join(side("b"), "b").mapInArrow(_exact(words, threshold), "a long, b long")


def _shared(sets: list[np.ndarray], here: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some sets with all, by products of bounded slices of their incidence matrix."""
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(code, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    use = np.flatnonzero(often[code])
    use = use[np.argsort(place[code[use]], kind="stable")]
    row, column = row[use], place[code[use]]
    shared = np.zeros((len(here), len(sets)), np.float32)
    for low in range(0, int(often.sum()), SLICE):
        cut = slice(*np.searchsorted(column, [low, low + SLICE]))
        part = np.zeros((len(sets), SLICE), np.float32)
        part[row[cut], column[cut] - low] = 1
        shared += part[here] @ part.T
    return shared


def _against(words: int, threshold: float):
    """Compares the far rows of a block with all its rows, by full sets; a link for each pair of groups that a link joins."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        sets = [s for chunk in H.chunks(table.column("text").to_pylist(), lower=True) for s in _sets(chunk, words)]
        size = np.array([len(s) for s in sets], np.float64)
        here = np.flatnonzero(table.column("far").to_numpy(zero_copy_only=False))
        shared = _shared(sets, here).astype(np.float64)
        union = size[here][:, None] + size[None, :] - shared
        i, j = np.nonzero((100 * shared >= round(100 * threshold) * union) & (ids[here][:, None] != ids[None, :]))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        out = []
        for x, y in zip(ids[here[i]].tolist(), ids[j].tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def links(docs: DataFrame, classes: DataFrame, sketched: DataFrame, words: int, threshold: float) -> DataFrame:
    """a, b: confirmed pairs of classes, which have the components of all such pairs.

    classes: doc_id, n, head. sketched: the sketches of these at least; deleted when read.
    """
    vals = classes.select("doc_id", "n", F.posexplode("head").alias("at", "value"))
    common = settled(vals.groupBy("value").agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
    mine = Window.partitionBy("doc_id")
    hot = F.sum((F.col("f") > LIST).cast("int"))
    tagged = (
        vals.join(common, "value")
        .withColumn("rank", F.col("at") - hot.over(mine.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("hot", hot.over(mine))
    )
    tagged = settled(tagged.select("value", "doc_id", "n", "f", "rank", "hot"))
    discard(common)
    cold = tagged.where((F.col("f") <= LIST) & (F.col("rank") < COLD))
    retained = F.least("n", F.lit(RETAINED))
    many = (retained - F.col("hot") < F.least("n", F.lit(COLD))) | (F.col("hot") * RETAINED >= retained * DENSE)
    dense = tagged.where((F.col("f") > LIST) & many)
    dense_lists = settled(dense.groupBy("value").agg(F.count(F.lit(1)).alias("g"), F.max_by("doc_id", F.struct("hot", -F.col("doc_id"))).alias("hub")).where("g > 1"))
    # written before anything groups it, so that Spark can split a common value's part of the join
    listed = settled(dense.join(dense_lists, "value").select("value", "doc_id", "n", "g", "hub"))
    short = listed.where(F.col("g") <= LIST).select("value", "doc_id", "n")
    pairs = settled(_pairs(cold.select("value", "doc_id", "n"), threshold).unionByName(_pairs(short, threshold)).select("a", "b").distinct())
    met = settled(listed.where(F.col("g") > LIST).select("doc_id", "n", "hub").distinct())
    discard(tagged, dense_lists, listed)
    spokes = met.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    likely = settled(_likely(pairs.union(spokes), sketched, threshold))
    discard(pairs, sketched)
    found = settled(_confirmed(likely, docs, words, threshold))
    discard(likely)
    more = settled(_far_links(met, found, docs, words, threshold))
    discard(met)
    return found.unionByName(more)


def _far_links(met: DataFrame, found: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """a, b: links of dense classes that no hub of theirs reaches, against all that met that hub."""
    near = found.select(F.col("a").alias("hub"), F.col("b").alias("doc_id")).distinct().withColumn("near", F.lit(True))
    # written, as three branches read it: else each of them has its stages in one plan, which the driver holds
    judged = settled(met.join(near, ["hub", "doc_id"], "left").withColumn("far", F.col("near").isNull() & (F.col("doc_id") != F.col("hub"))).drop("near"))
    # so many blocks that one holds about BLOCK rows and BLOCK_SHINGLES shingles at most
    many = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    counts = judged.groupBy("hub").agg(
        many(F.count_if("far"), F.coalesce(F.sum(F.when(F.col("far"), F.col("n"))), F.lit(0))).alias("blocks"), many(F.count(F.lit(1)), F.sum("n")).alias("parts")
    ).where("blocks > 0")
    mixed = F.xxhash64("doc_id", F.lit("block"))
    rows = judged.join(counts, "hub").withColumn("block", F.pmod(mixed, "blocks").cast("int")).withColumn("part", F.pmod(mixed, "parts").cast("int"))
    # a far row goes to its block for each part; each row goes to its part for each block
    asks = rows.where("far").select("hub", "doc_id", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("far"))
    gives = rows.select("hub", "doc_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", F.lit(False).alias("far"))
    laid = asks.union(gives).hint("merge").join(docs, "doc_id")
    return laid.groupBy("hub", "block", "part").applyInArrow(_against(words, threshold), "a long, b long")


def groups(docs: DataFrame, words: int = 4, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    docs = identified(docs)
    sketched = settled(sketches(docs, words))
    sizes = settled(sketched.select("doc_id", "n", "one", "two"))
    first = settled(sizes.where("n > 0 and doc_id is not null").groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep")))
    filled = sketched.where("n > 0 and doc_id is not null")
    stand = filled.select("doc_id", "n", "head").join(first.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    classes = settled(stand.groupBy("doc_id").agg(F.max(F.struct("n", "head")).alias("s")).select("doc_id", "s.n", "s.head"))
    linked = links(docs.where("doc_id is not null"), classes, sketched, words, threshold)
    label = components(linked).select(F.col("node").alias("rep"), "label")
    named = settled(first.join(label, "rep", "left").select("one", "two", "n", F.coalesce("label", "rep").alias("component_id")))
    discard(first, classes)
    out = sizes.join(named, ["one", "two", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs without those that another of their group stands for."""
    gone = settled(groups(docs, words, threshold).where(~F.col("kept")).select(F.col("doc_id").alias(unused(docs, "gone"))))
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))
