"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Tokens are runs of letters and digits, lower-cased. An overlap is OVERLAP consecutive
tokens of an item and as many of a document, equal but for up to SUBSTITUTIONS tokens
at their places; an item of fewer tokens, but at least SHORTEST, must occur whole, with
the substitutions its length allows in proportion.

A seed is a window of SPAN tokens of which a mask looks at some only. The masks look at
two of four interleaved groups of places, so whichever two tokens differ, one mask sees
none of them. Items give seeds at every place, documents at every STRIDE-th: OVERLAP is
SPAN + STRIDE - 1, so every overlap holds a whole seed. Test and training hashes are joined, and each
hit names a document, an item and their offset. Around hits the tokens are compared place by
place on the item, and the best run of OVERLAP places decides.

Of an item under OVERLAP tokens, with at most one substitution, two masks of every other
place are sought at all places of documents, for the lengths that the benchmark has.

Items are often made from templates, so the same tokens around a seed stand in many of
them. Seeds are kept once for each such context, hits are verified on one item of the
context, and only hits that hold are shared out to the items. clean() needs no items, and
judges texts, not ids.

Seeds are broadcast where there are BROADCAST_SEEDS rows or fewer; beyond that Spark
joins them by a shuffle of seed hashes. Documents' seeds are not shuffled in the first
case. Nothing else is broadcast by hand.

Null text: no tokens. Null item_id or doc_id: reported as null; such a document goes if
its text overlaps. Items under SHORTEST tokens: never reported. Repeated rows: each is
reported; rows that share a doc_id are reported once for an item, by their best overlap.
Ties: of equally good overlaps the first in the document, then in the item. Very long
texts: whole, in rows of PIECE tokens. Empty table: empty result. Extra columns are
ignored by hits() and kept by clean(), whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import documents, settled, table, unused

OVERLAP = 13
SUBSTITUTIONS = 2
SPAN = 10
STRIDE = OVERLAP - SPAN + 1
#: Fewest tokens of an item that is searched; those of fewer than OVERLAP must occur whole.
SHORTEST = 5
GROUPS = 4
MASKS = [[p for p in range(SPAN) if p % GROUPS in pair] for pair in combinations(range(GROUPS), 2)]
BROADCAST_SEEDS = 500_000
#: Tokens of a document that one row holds; rows overlap by what a seed needs.
PIECE = 256


def tokens(text: Column) -> Column:
    """64-bit hashes of the tokens of a text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(hashes: Column, starts: Column) -> Column:
    """mask, at and seed of every mask at every start."""
    one = lambda at, k: F.struct(F.lit(k).alias("mask"), at.cast("int").alias("at"), F.xxhash64(F.lit(k), *[F.get(hashes, (at + p).cast("int")) for p in MASKS[k]]).alias("seed"))
    return F.flatten(F.transform(starts, lambda at: F.array(*[one(at, k) for k in range(len(MASKS))])))


def _starts(first: Column, last: Column, step: int) -> Column:
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each distinct token sequence, item_no and tokens; and one for each item, item_id and item_no."""
    held = benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= SHORTEST).withColumn("item_no", F.xxhash64("tokens"))
    return settled(held.groupBy("item_no").agg(F.min("tokens").alias("tokens"))), held.select("item_id", "item_no")


def allowed(n):
    """Substitutions in an item of n tokens, under OVERLAP."""
    return SUBSTITUTIONS * n // OVERLAP


def _short_seeds(hashes: Column, starts: Column, n: int) -> Column:
    """at and seed of an item's n tokens, or of every other of them where one may differ."""
    masks = [range(k, n, 2) for k in (0, 1)] if allowed(n) else [range(n)]
    one = lambda at, k: F.struct(at.cast("int").alias("at"), F.xxhash64(F.lit(n), F.lit(k), *[F.get(hashes, (at + p).cast("int")) for p in masks[k]]).alias("seed"))
    return F.flatten(F.transform(starts, lambda at: F.array(*[one(at, k) for k in range(len(masks))])))


def _bounded(df: DataFrame) -> DataFrame:
    """For a broadcast where df, a written table, is small enough; else Spark decides by its size."""
    return F.broadcast(df) if df.count() <= BROADCAST_SEEDS else df


def _short(pieces: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """key, item_no, matched, item_start and doc_start of the whole occurrences of items of n tokens."""
    held = known.where(F.size("tokens") == n).select("item_no", F.col("tokens").alias("item"))
    seeds = settled(held.select("item_no", "item", F.explode(_short_seeds(F.col("item"), F.array(F.lit(0)), n)).alias("s")).select("item_no", "item", F.col("s.seed").alias("seed")))
    last = F.least(F.size("tokens") - n, F.col("lead") + PIECE - 1)
    probes = pieces.withColumn("s", F.explode(_short_seeds(F.col("tokens"), _starts(F.col("lead").cast("int"), last.cast("int"), 1), n)))
    met = probes.join(_bounded(seeds), F.col("s.seed") == F.col("seed"))
    matched = F.size(F.filter(F.zip_with("item", F.slice("tokens", F.col("s.at") + 1, n), lambda x, y: x == y), lambda same: same))
    found = met.select("key", "item_no", matched.alias("matched"), F.lit(0).alias("item_start"), (F.col("begin") - F.col("lead") + F.col("s.at")).alias("doc_start"))
    return found.where(F.col("matched") >= n - allowed(n))


def _overlaps(texts: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where texts (key, text) overlap items.

    Hits of a context: key, context, matched, doc_start, at (of the overlap, from the
    seed). Contexts: context, item_no, item_at of each item that has it. Hits of short
    items: key, item_no, matched, item_start, doc_start.
    """
    margin = OVERLAP - 1
    whole = _starts(F.lit(0), F.when(F.size("tokens") >= OVERLAP, F.size("tokens") - SPAN).otherwise(-1), 1)
    around = F.slice("tokens", F.greatest(F.col("s.at") - margin, F.lit(0)) + 1, SPAN + F.least("s.at", F.lit(margin)) + margin)
    context = F.xxhash64(around, F.least("s.at", F.lit(margin)))
    seeded = known.select("item_no", "tokens", F.explode(_seeds(F.col("tokens"), whole)).alias("s")).select("item_no", "s.mask", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at"), context.alias("context"))
    seeded = settled(seeded)
    contexts = settled(seeded.where("mask = 0").select("context", "item_no", "item_at"))
    one = contexts.groupBy("context").agg(F.min(F.struct("item_no", "item_at")).alias("i")).select("context", "i.item_no", "i.item_at")
    seeds = settled(seeded.select("seed", "context").distinct().join(one, "context"))
    lengths = [r.n for r in known.where(F.size("tokens") < OVERLAP).select(F.size("tokens").alias("n")).distinct().collect()]

    # Pieces of PIECE tokens, each with what its last seed and the check around it need
    hashes = texts.select("key", tokens(F.col("text")).alias("all")).where(F.size("all") >= F.lit(min([OVERLAP, *lengths])))
    pieces = hashes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.size("all") / PIECE).cast("int") - 1)))
    begin = F.col("piece") * PIECE
    pieces = pieces.select(
        "key", begin.alias("begin"), F.slice("all", F.greatest(begin - margin, F.lit(0)) + 1, PIECE + SPAN + 2 * margin).alias("tokens"),
        F.least(begin, F.lit(margin)).alias("lead"),
    )
    last = F.least(F.size("tokens") - SPAN, F.col("lead") + PIECE - 1)
    probes = pieces.withColumn("s", F.explode(_seeds(F.col("tokens"), _starts(F.col("lead").cast("int"), last.cast("int"), STRIDE))))
    met = probes.join(_bounded(seeds), F.col("s.seed") == F.col("seed"))

    # The diagonal: the places of the item, against those of the piece at the same offset
    met = met.join(known.select("item_no", F.col("tokens").alias("item")), "item_no")
    shift = F.col("s.at") - F.col("item_at")
    low = F.greatest(F.col("item_at") - margin, F.lit(0), -shift)
    high = F.least(F.col("item_at") + SPAN + margin, F.size("item"), F.size("tokens") - shift)
    same = F.transform(F.sequence(low, high - 1), lambda i: (F.get("item", i) == F.get("tokens", i + shift)).cast("int"))
    met = met.withColumn("low", low).withColumn("same", same).where(F.size("same") >= OVERLAP)
    runs = F.transform(F.sequence(F.lit(0), F.size("same") - OVERLAP), lambda i: F.struct(F.aggregate(F.slice("same", i + 1, OVERLAP), F.lit(0), lambda a, x: a + x).alias("n"), (-i).alias("at")))
    met = met.withColumn("best", F.array_max(runs)).where(F.col("best.n") >= OVERLAP - SUBSTITUTIONS)
    at = F.col("low") - F.col("best.at") - F.col("item_at")
    found = met.select("key", "context", F.col("best.n").alias("matched"), (F.col("begin") - F.col("lead") + F.col("s.at") + at).alias("doc_start"), at.alias("at"))
    none = known.select(F.lit(None).cast(dict(texts.dtypes)["key"]).alias("key"), "item_no", *[F.lit(0).alias(c) for c in ("matched", "item_start", "doc_start")]).limit(0)
    short = none
    for n in lengths:
        short = short.unionByName(_short(pieces, known, n))
    return found, contexts, short


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, item_tokens, doc_start and item_start of the best overlap of each document and item that overlap."""
    known, named = items(benchmark)
    found, contexts, short = _overlaps(docs.select(F.col("doc_id").alias("key"), "text"), known)
    # an overlap that several seeds of a context find is one
    best = found.groupBy("key", "context", "at").agg(F.max(F.struct("matched", (-F.col("doc_start")).alias("d"))).alias("b"))
    each = best.join(contexts, "context").select("key", "item_no", F.col("b.matched").alias("matched"), (F.col("item_at") + F.col("at")).alias("item_start"), (-F.col("b.d")).alias("doc_start"))
    each = each.unionByName(short)
    most = each.groupBy("key", "item_no").agg(F.max(F.struct("matched", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("b"))
    sized = named.join(known.select("item_no", F.size("tokens").alias("item_tokens")), "item_no")
    return most.join(sized, "item_no").select(F.col("key").alias("doc_id"), "item_id", F.col("b.matched").alias("matched"), "item_tokens", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text overlaps no item."""
    known, _ = items(benchmark)
    both = lambda text: F.struct(F.xxhash64(text), F.xxhash64(text, F.lit(1)))
    found, _, short = _overlaps(docs.select(both(F.col("text")).alias("key"), "text"), known)
    dirty = settled(found.select("key").union(short.select("key")).distinct())
    name = unused(docs, "dirty")
    return docs.join(dirty.withColumnRenamed("key", name), both(docs["text"]) == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
