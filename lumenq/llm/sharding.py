"""Sharding by sampled splitters, with DataFrame functions only.

Law `bytes`: shards of near equal size. Records are ordered by a hash of their text,
so equal texts lie together, and then by doc_id. A sample of keys, drawn with chances
in proportion to size, gives quantile boundaries; these cut the key space into ranges
that one task can sort. Ranges that prove overfull, as a text of very many copies
makes them, are divided again by a hash of doc_id and the row. Exact sizes of all ranges
then place every record on one line of bytes, which is cut into equal shards. `Near
equal` is to TOLERANCE of a shard: a cut that falls inside a group of equal texts moves
to the group's nearer end where that is closer than half of TOLERANCE, so that all but
very large groups are whole, in tables of every size.

Null text: size 8 and crc32 of nothing, 0. Null doc_id: sorts first. Repeated rows: each
gets a slot of its own. Ties: records of equal text go by doc_id. Very long texts: whole;
a shard is off its share by the longest text at most beside TOLERANCE. Empty table: empty
result. Extra columns are ignored by assign; attach keeps them, whatever their names,
and calls its own shard_ and slot_ where docs has columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import documents, settled, unused

SHARDS = 24
OVERHEAD = 8
#: Bytes that one task sorts, about; and the least and most ranges.
RANGE_BYTES = 128 << 20
LEAST_RANGES, MOST_RANGES = 4 * SHARDS, 16384
#: Keys sampled for each range, about.
PER_RANGE = 20
#: What shards may differ by, as a share of a shard, to keep groups of equal texts whole.
TOLERANCE = 0.02
#: The key space has this many cells, in which boundaries are looked up.
CELL_BITS = 12


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _cell(key: Column) -> Column:
    return F.shiftright(key, 64 - CELL_BITS)


def splitters(sized: DataFrame, total: int, ranges: int) -> DataFrame:
    """cell, range_id, low, high: the range of a key is that of its cell with low <= key < high.

    At most ranges + 2**CELL_BITS rows.
    """
    chance = F.col("size") * F.lit(ranges * PER_RANGE / max(total, 1))
    draw = (F.xxhash64(F.col("doc_id"), F.col("key"), F.lit("draw")) / F.lit(2.0**64)) + 0.5
    sample = sized.where(draw < chance).select("key")
    # ntile over a sample whose size is bounded by the parameters: about ranges * PER_RANGE keys
    cut = sample.select("key", F.ntile(ranges).over(Window.orderBy("key")).alias("tile")).groupBy("tile").agg(F.min("key").alias("low"))
    lowest, highest = -(1 << 63), (1 << 63) - 1
    bounds = cut.where("tile > 1").select("low").distinct().union(sized.sparkSession.range(1).select(F.lit(lowest).alias("low")))
    line = Window.orderBy("low")
    bounds = bounds.select("low", F.lead("low").over(line).alias("high"), F.row_number().over(line).alias("range_id"))
    last = F.coalesce(F.col("high"), F.lit(highest))
    return bounds.select("range_id", "low", "high", F.explode(F.sequence(_cell(F.col("low")), _cell(last))).alias("cell"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row_id"))
    sized = settled(sized)
    total = sized.agg(F.sum("size")).first()[0] or 0
    ranges = min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES))
    cuts = settled(splitters(sized, total, ranges))
    key = F.col("key")
    # bounded: at most MOST_RANGES + 2**CELL_BITS rows
    placed = sized.withColumn("cell", _cell(key)).join(F.broadcast(cuts), "cell").where((F.col("low") <= key) & (F.col("high").isNull() | (key < F.col("high"))))
    # A range over twice its due is divided
    full = placed.groupBy("range_id").agg(F.sum("size").alias("bytes"))
    parts = settled(full.select("range_id", F.greatest(F.lit(1), F.ceil(F.col("bytes") * ranges / (2 * max(total, 1)))).cast("int").alias("parts")))
    placed = placed.join(F.broadcast(parts), "range_id").withColumn("part", F.pmod(F.xxhash64("doc_id", "row_id"), F.col("parts")).cast("int"))
    placed = placed.select("range_id", "part", "key", "doc_id", "size", "text_crc32")
    # Where each part begins on the line of all bytes and rows
    sums = placed.groupBy("range_id", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settled(sums.select("range_id", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("first_byte"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_row")))
    inside = Window.partitionBy("range_id", "part").orderBy("key", "doc_id", "size")
    group = Window.partitionBy("range_id", "part", "key")
    share = total / shards
    at = (
        placed.withColumn("row", F.row_number().over(inside))
        .withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_end", F.max("end").over(group))
        # starts has a row for each part: at most MOST_RANGES + twice as many parts
        .join(F.broadcast(starts), ["range_id", "part"])
    )
    middle = F.when(F.col("group_bytes") <= share * TOLERANCE, F.col("group_end") - F.col("group_bytes") / 2).otherwise(F.col("end") - F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor((F.col("first_byte") + middle) * shards / max(total, 1))).cast("int")
    at = at.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("first_row") + F.col("row")).alias("place"))
    at = settled(at)
    # one row a shard
    heads = at.groupBy("shard").agg(F.min("place").alias("head"))
    return at.join(F.broadcast(heads), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("head")).alias("slot"))


def attach(docs: DataFrame, assigned: DataFrame) -> DataFrame:
    """The rows of docs with shard and slot. Rows of one doc_id and text are interchangeable."""
    crc, copy, shard, slot = (unused(docs, x) for x in ("text_crc", "text_copy", "shard", "slot"))
    copies = lambda key, order: F.row_number().over(Window.partitionBy("doc_id", key).orderBy(*order))
    left = docs.withColumn(crc, F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).withColumn(copy, copies(crc, [F.lit(0)]))
    right = assigned.select(F.col("doc_id").alias("of"), F.col("text_crc32").alias("c"), copies("text_crc32", ["shard", "slot"]).alias("k"), F.col("shard").alias(shard), F.col("slot").alias(slot))
    same = left["doc_id"].eqNullSafe(right["of"]) & (left[crc] == right["c"]) & (left[copy] == right["k"])
    return left.join(right, same).select(*[left[f"`{c}`"] for c in docs.columns], right[shard], right[slot])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
