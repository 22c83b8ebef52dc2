"""Line dedup, with DataFrame functions only.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Lines
are exploded to (document, position, hash of the key), the distinct documents of each
hash are counted, and lines whose key of at least MIN_CHARS code points is in MIN_DOCS
documents or more are dropped, but for those in the largest doc_id that holds it. What
stays is put together again by position.

Hashes have 16 bytes and are computed once. The texts are shuffled once, as arrays of
lines, to meet the list of positions that each document loses; the positions that stay
are the difference of two sets, in time linear in the lines. Counts are partly summed
before the shuffle, so a line of every document costs a row per task. The lines that go
are joined on a key that one line may fill; Spark splits such partitions.

Null text: one empty line. Null doc_id: such a row counts for no line and loses none.
Rows that share a doc_id count as one document; each text of it loses lines of its own.
Repeated rows: each is returned. Ties cannot arise: the largest id keeps. Very long
texts: whole; a document's lines are in one row. Empty table: empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import documents, settled

MIN_CHARS = 20
MIN_DOCS = 3
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(line: Column, min_chars: int) -> Column:
    """16 bytes for a line whose key is long enough, else null."""
    key = F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))


def excess(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """doc_id, version (a hash of the text) and the positions, from 0, of the lines that it loses."""
    lined = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    keys = settled(lined.select("doc_id", "version", "pos", key_hash(F.col("line"), min_chars).alias("key")).where("key is not null"))
    common = settled(
        keys.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("key", "keeper")
    )
    lost = keys.join(common, "key").where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("lost"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, the text without the lines that go, and how many lines it had and lost."""
    docs = docs.select("doc_id", "text")
    # split below the join, so that the lines are an array there and not split anew for each position
    lined = docs.select("doc_id", F.xxhash64("text").alias("version"), lines(F.col("text")).alias("lines"))
    joined = lined.join(excess(docs, min_chars, min_docs), ["doc_id", "version"], "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(stays, lambda pos: F.get("lines", pos)))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept")).select(
        "doc_id", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH lined AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lined
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""
