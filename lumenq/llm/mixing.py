"""Mixing sources to target weights, with DataFrame functions only.

Sources in order of code points, null last, weigh 5, 2, 1, repeating, and share
TOTAL_SHARE of all words; no source gives more than twice its words, and what it
can't give is shared again by weight. Golden-ratio points, mapped through the
cumulative target weights, name the source of each slot of the mix. A source's slots
are ranked and meet its blocks, which are equal runs of words over its documents in
shuffled order, the second pass after the first.

The schedule decides what is taken: a source gives as many blocks as it has slots, so
its words differ from its target by a few blocks, as a low-discrepancy sequence bounds
it. Blocks have between 1 and BLOCK_WORDS words, such that there are about LEAST_SLOTS
slots or more. Only the limit of twice its words cuts a source's last block.

Nothing is gathered per source: documents are ordered inside (source, bucket) groups
of about BUCKET_WORDS words, and slots inside runs of consecutive slots, and offsets
are summed over these. Nothing bounds the number of sources: running sums over them go
by ranges, and no table of them is broadcast by hand.

Null text: no words, takes part with 0. Null source: a source of its own, last. Null
doc_id: handled as any id. Repeated rows: each is a document of its own; those that
share doc_id and text can't be told apart, and their order is arbitrary. Very long
texts: as any; their words lie in many blocks. Ties of the shuffled order go by doc_id.
Empty table: empty result. Extra columns are ignored by taken() and kept by repeat(),
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import discard, documents, settled, unused

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_TIMES = 2
BLOCK_WORDS = 256
LEAST_SLOTS = 1 << 20
BUCKET_WORDS = 1 << 18
#: Slots ranked by one task at once.
RUN_SLOTS = 1 << 14
#: 2**32 divided by the golden ratio; points are its multiples modulo 2**32.
GOLDEN = 2654435769
POINTS = 1 << 32


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), *more)


def running(rows: DataFrame, order: list[Column], **terms: Column) -> DataFrame:
    """rows with the sums of each term over the rows before, in an order without ties.

    Rows are dealt to ranges of the order; only a row for each range meets in one task.
    """
    dealt = settled(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before = lambda over: over.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("range").agg(*[F.sum(term).alias(f"in_{name}") for name, term in terms.items()])
    starts = sums.select("range", *[F.coalesce(F.sum(f"in_{name}").over(before(Window.orderBy("range"))), F.lit(0)).alias(f"at_{name}") for name in terms])
    inside = before(Window.partitionBy("range").orderBy(*order))
    sum_of = lambda name, term: (F.col(f"at_{name}") + F.coalesce(F.sum(term).over(inside), F.lit(0))).alias(name)
    return dealt.join(starts, "range").select(*rows.columns, *[sum_of(name, term) for name, term in terms.items()])


def targets(sized: DataFrame) -> DataFrame:
    """A row for each source: its number from 0, words, target, and its part [low, high) of the points.

    A source is at its limit when its limit over its weight is at most the level that
    is left for all sources with as much or more; the levels are running sums in the
    order of that ratio.
    """
    listed = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = running(listed, [F.col("source").isNull(), F.col("source")], number=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    listed = settled(listed.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(MOST_TIMES)).withColumn("ratio", F.col("limit") / F.col("weight")))
    words, weights = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    ordered = running(listed, [F.col("ratio"), F.col("number")], full=F.col("limit"), passed=F.col("weight"))
    level = (F.lit(words * TOTAL_SHARE) - F.col("full")) / (F.lit(weights) - F.col("passed"))
    first = ordered.where(F.col("limit") > level * F.col("weight")).agg(F.min(F.struct("ratio", "number", level.alias("level")))["level"]).first()[0]
    target = F.col("limit") if first is None else F.least("limit", F.lit(first) * F.col("weight"))
    listed = listed.select("source", "number", "source_size", target.alias("target"))
    whole = max(listed.agg(F.sum("target")).first()[0] or 0.0, 1e-9)
    listed = running(listed, [F.col("number")], upto=F.col("target"))
    point = lambda x: F.round(x / F.lit(whole) * POINTS).cast("long")
    return listed.select("source", F.col("number").alias("source_no"), "source_size", "target", point(F.col("upto")).alias("low"), point(F.col("upto") + F.col("target")).alias("high"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, source_no, rank: the source of each slot, and how many of its slots come before."""
    spark = sources.sparkSession
    point = F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * GOLDEN, F.lit(POINTS))
    # a cell holds a few sources, however many there are
    cells = 1 << min(24, max(12, sources.count().bit_length() + 2))
    cell = lambda p: F.floor(p / (POINTS // cells)).cast("int")
    drawn = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / RUN_SLOTS).alias("run"), point.alias("point")).withColumn("cell", cell(F.col("point")))
    parts = sources.where("low < high").select("source_no", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    named = drawn.join(parts, "cell").where("low <= point and point < high").select("slot", "run", "source_no")
    # Runs that hold rows of all sources, so that none is larger than RUN_SLOTS
    inside = F.row_number().over(Window.partitionBy("run", "source_no").orderBy("slot")) - 1
    counts = named.groupBy("source_no", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # written, here and in blocks(), so that the driver doesn't hold these stages in the plan of the mix too
    starts = settled(counts.select("source_no", "run", before.alias("first")))
    return named.withColumn("inside", inside).join(starts.hint("merge"), ["source_no", "run"]).select("slot", "source_no", (F.col("first") + F.col("inside")).alias("rank"))


def blocks(numbered: DataFrame, block_words: int) -> DataFrame:
    """source_no, rank, row_id, pass, first, words: which words of which document a block has.

    numbered: row_id, doc_id, source_no, source_size, size, bucket, order.
    """
    group = Window.partitionBy("source_no", "bucket")
    end = F.sum("size").over(group.orderBy("order", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, 0))
    sums = numbered.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = settled(sums.select("source_no", "bucket", before.alias("first")))
    laid = numbered.where("size > 0").withColumn("end", end).join(starts.hint("merge"), ["source_no", "bucket"])
    begin = F.col("first") + F.col("end") - F.col("size") + F.col("pass") * F.col("source_size")
    laid = laid.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_TIMES - 1)))).withColumn("begin", begin)
    last = F.col("begin") + F.col("size")
    cut = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((last - 1) / block_words))))
    start = F.greatest("begin", F.col("rank") * block_words)
    words = F.least(last, (F.col("rank") + 1) * block_words) - start
    return cut.select("source_no", "rank", "row_id", "pass", (start - F.col("begin")).alias("first"), words.alias("words"))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix, the documents and the sources.

    Mix: slot, source_no, rank, row_id, pass, first, words, a row for each run of words of
    a document in a slot. Documents: row_id, doc_id, source_no, source_size, target, size.
    """
    # documents that share an id, or have none, are spread by their text
    text = F.xxhash64("doc_id", "text").alias("order")
    sized = settled(sizes(docs, text).withColumn("row_id", F.monotonically_increasing_id()))
    sources = settled(targets(sized))
    words, wanted = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    block_words = int(min(BLOCK_WORDS, max(1, wanted // LEAST_SLOTS)))
    buckets = max(1, -(-words // BUCKET_WORDS))
    name = sources.select(F.col("source").alias("named"), "source_no", "source_size", "target")
    bucket = F.pmod(F.xxhash64("order", F.lit("bucket")), F.lit(buckets)).alias("bucket")
    numbered = settled(sized.join(name, F.col("source").eqNullSafe(F.col("named"))).select("row_id", "doc_id", "source_no", "source_size", "target", "size", bucket, "order"))
    discard(sized)
    # neither side is ever broadcast: the plan's estimate of the blocks leaves out what explode makes of the documents
    mixed = blocks(numbered, block_words).hint("merge").join(schedule(sources, round(wanted / block_words)), ["source_no", "rank"])
    return mixed, numbered, sources


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row, its first slot (null: none) and how many slots have words of it."""
    mixed, numbered, _ = mix(docs)
    sums = mixed.groupBy("row_id").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("slots"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return numbered.join(sums, "row_id", "left").select("doc_id", "size", "source_size", "target", none("taken"), "first_slot", none("slots"), "order")


def repeat(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, to the nearest whole time.

    A source's blocks follow its documents, so at most one document of each source is
    taken in part, and a source's words are off those of the mix by half of it at most.
    """
    sums = settled(taken(docs).groupBy("order").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).where("s > 0"))
    key, many, turn = (unused(docs, x) for x in ("taken_order", "taken_times", "taken_turn"))
    times = sums.select(F.col("order").alias(key), F.round(F.col("t") / F.col("s")).cast("int").alias(many)).where(F.col(many) > 0)
    both = docs.join(times, F.xxhash64(docs["doc_id"], docs["text"]) == times[key])
    return both.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(documents(spark, sf_dir)).drop("order")
