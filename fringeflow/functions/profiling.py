"""Time by stack of named steps: steps name Spark's jobs too, and records are summed as DataFrames."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "stack array<string>, labels map<string,string>, start double, stop double"


class Profiler:
    """Collects a record (stack, labels, start, stop) for each step; labels of inner steps go over those of outer ones. Jobs run in a step are in a group of its name."""

    def __init__(self, spark: SparkSession | None = None, clock: Callable[[], float] = time.monotonic):
        self.spark, self.clock, self.rows, self._now = spark, clock, [], []

    def _name_jobs(self) -> None:
        if self.spark is not None:
            context = self.spark.sparkContext
            if self._now:
                context.setJobGroup(";".join(n for n, _ in self._now), str(self._labels()))
            else:
                context.setLocalProperty("spark.jobGroup.id", None)
                context.setLocalProperty("spark.job.description", None)

    def _labels(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for _, labels in self._now:
            out |= labels
        return out

    @contextmanager
    def step(self, name: str, **labels) -> Iterator[None]:
        self._now.append((name, {k: str(v) for k, v in labels.items()}))
        self._name_jobs()
        start = self.clock()
        try:
            yield
        finally:
            self.rows.append(([n for n, _ in self._now], self._labels(), start, self.clock()))
            self._now.pop()
            self._name_jobs()

    def profile(self, name: str | None = None, labels: tuple[str, ...] = ()) -> Callable:
        """A decorator: a call is a step; ``labels`` are keyword arguments of its own that label it."""

        def wrap(function: Callable) -> Callable:
            @functools.wraps(function)
            def run(*args, **kwargs):
                with self.step(name or function.__name__, **{k: kwargs[k] for k in labels if k in kwargs}):
                    return function(*args, **kwargs)

            return run

        return wrap

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, RECORDS)


def exclusive(records: DataFrame) -> DataFrame:
    """(stack, seconds): the time of each stack less that of the steps in it, stacks joined by semicolons."""
    took = F.col("stop") - F.col("start")
    own = records.select(F.concat_ws(";", "stack").alias("stack"), took.alias("seconds"))
    outer = records.where(F.size("stack") > 1).select(F.concat_ws(";", F.slice("stack", F.lit(1), F.size("stack") - 1)).alias("stack"), (-took).alias("seconds"))
    return own.union(outer).groupBy("stack").agg(F.sum("seconds").alias("seconds"))


def write_flamegraph(records: DataFrame, path: str) -> None:
    """Lines ``stack microseconds`` as text files: what flame graphs are drawn from. Steps of no time of their own are left out."""
    lines = exclusive(records).withColumn("n", F.round(F.col("seconds") * 1e6).cast("long")).where("n > 0")
    lines.select(F.concat_ws(" ", "stack", F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(path)
