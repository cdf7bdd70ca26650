"""Compressed records on shared storage, bucketed so that later steps join and sum them where they lie."""

from __future__ import annotations

import tempfile
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A record's part of the store: channel, w slice and band of grid rows.
PART = ["channel", "w_slice", "band"]
#: Grid rows of a band: what is heavy in one slice is dealt over bands.
BAND = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one is made only where the session names none, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return folder or context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, where its lineage ends."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_band(records: DataFrame) -> DataFrame:
    return records.withColumn("band", F.floor(F.col("v") / BAND).cast("int"))


def write(records: DataFrame, folder: str, buckets: int | None = None) -> str:
    """Write ``records`` (channel, w_slice, v, ...) under ``folder``, which all executors share, as a bucketed table; gives its name for ``read`` and ``drop``."""
    spark = records.sparkSession
    name = f"records_{uuid.uuid4().hex}"
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = with_band(records).repartition(count, *PART)  # a file a bucket
    d.write.bucketBy(count, *PART).sortBy(*PART, "v", "u").option("path", f"{folder.rstrip('/')}/{name}").saveAsTable(name)
    return name


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def drop(spark: SparkSession, name: str) -> None:
    """Forget the table and remove its files."""
    location = next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r["col_name"] == "Location")
    spark.sql(f"DROP TABLE {name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Store(ABC):
    """Where compressed records are kept between steps; a context that is left forgets them."""

    @abstractmethod
    def records(self) -> DataFrame: ...

    @abstractmethod
    def close(self) -> None: ...

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class TableStore(Store):
    """A bucketed table in the shared folder: what a lost executor held is read again."""

    def __init__(self, records: DataFrame, buckets: int | None = None):
        self.spark = records.sparkSession
        self.name = write(records, shared_folder(self.spark), buckets)

    def records(self) -> DataFrame:
        return read(self.spark, self.name)

    def close(self) -> None:
        drop(self.spark, self.name)


class MemoryStore(Store):
    """Records dealt to their parts and held by the executors, on their disks where memory ends: for small runs, as what is lost is made again from the samples."""

    def __init__(self, records: DataFrame, buckets: int | None = None):
        count = buckets or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.held = with_band(records).repartition(count, *PART).sortWithinPartitions(*PART, "v", "u").persist()

    def records(self) -> DataFrame:
        return self.held

    def close(self) -> None:
        self.held.unpersist()


@contextmanager
def in_place(spark: SparkSession, **more: str) -> Iterator[None]:
    """While it holds, tables bucketed by some of a join's keys are joined without dealing them anew; the session's settings come back after it."""
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.bucketing.coalesceBucketsInJoin.enabled": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"} | {k.replace("__", "."): v for k, v in more.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lengths(records: DataFrame) -> DataFrame:
    """(channel, w_slice, records): slices without records have no row."""
    return records.groupBy("channel", "w_slice").agg(F.count("*").alias("records"))


def blocks(records: DataFrame, size: int) -> DataFrame:
    """``records`` with ``block``: runs of ``size`` records of a part in grid order, the last of a part shorter. Parts are numbered where they lie."""
    order = Window.partitionBy(*PART).orderBy("v", "u", "sub_v", "sub_u", "w_plane", "pol")
    return records.withColumn("block", F.floor((F.row_number().over(order) - 1) / size))
