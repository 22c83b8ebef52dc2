"""Reading the tables, and materialising what is used more than once."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only where that is
    unset and the session runs on this machine alone, as in tests, it is a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "lumenq-checkpoints")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


#: Tables that settled() has written, for discard().
_written: WeakKeyDictionary = WeakKeyDictionary()
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder, so that it is neither computed
    again nor lost with an executor. Columns that a reader doesn't use aren't read. What
    was shuffled for it is deleted as soon as it is written."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}", spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that settled() wrote and that nothing reads from now on."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_written.pop(df))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(docs: DataFrame, name: str) -> str:
    """The name, or one like it that docs has no column of."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as UTF-8, only. A doc_id that is long already is no new
    column, so that plans which read it twice are alike and share their shuffle."""
    doc_id = F.col("doc_id")
    if dict(docs.dtypes)["doc_id"] != "bigint":
        doc_id = doc_id.cast("long").alias("doc_id")
    return docs.select(doc_id, F.col("text").cast("binary").alias("text"))
