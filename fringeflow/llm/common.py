"""Session helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null counts as empty) and columns ``more``; rows without a doc_id can't be named in a result and are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more).where(F.col("doc_id").isNotNull())


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what Python workers hold at once: at most ``rows`` texts a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset (tests) one made here."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in folders ``by`` columns if any, and read it back: lineage ends there, and shuffle files behind it can be cleaned at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.partitionBy(*by).parquet(path)
    del df
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the finished shuffles
    out = spark.read.schema(schema).parquet(path)
    out.folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the folders of frames that ``materialise`` gave and that nothing reads any more, whether to run or to run again."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spare(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: Column, n: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % n
