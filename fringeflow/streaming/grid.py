"""Streams of records: gridding is a sum, so what arrives is added, and a stream that stops goes on where it was."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORDS = "row_id long, time double, channel long, pol long, u long, v long, weight double, re double, im double"
SUMS = "channel long, pol long, u long, v long, weight double, re double, im double"
CELL = ["channel", "pol", "u", "v"]


def cell_sums(records: DataFrame) -> DataFrame:
    return records.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ("weight", "re", "im")])


def grid_stream(spark: SparkSession, path: str, schema: str = RECORDS) -> DataFrame:
    """Running cell sums of records that arrive as Parquet files under ``path``, kept in the stream's state."""
    return cell_sums(spark.readStream.schema(schema).parquet(path))


def grid_into(records: DataFrame, folder: str) -> StreamingQuery:
    """Add a stream of records to the grid in ``folder``: the cell sums of each batch are a folder of its own that a repeated batch overwrites, and its status is written
    last. Starting it again on the same folder goes on after the last finished batch and counts nothing twice."""

    def add(batch: DataFrame, number: int) -> None:
        seen = Observation(f"batch-{number}")
        watched = batch.observe(seen, F.count("*").alias("records"), F.sum("weight").alias("weight"), F.sum("time").alias("time_sum"))
        cell_sums(watched).write.mode("overwrite").parquet(f"{folder}/cells/batch={number}")
        got = seen.get
        row = [(number, int(got["records"]), float(got["weight"] or 0.0), float(got["time_sum"] or 0.0), datetime.now(timezone.utc).isoformat())]
        batch.sparkSession.createDataFrame(row, "batch long, records long, weight double, time_sum double, written string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/status/number={number}")

    return records.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def status(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, records, weight, time_sum, written) of finished batches."""
    schema = "batch long, records long, weight double, time_sum double, written string"
    try:
        return spark.read.schema(schema).parquet(f"{folder}/status").select("batch", "records", "weight", "time_sum", "written")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """One row: batches, records and mean time of what is in the grid so far."""
    return status(spark, folder).agg(F.count("*").alias("batches"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), (F.sum("time_sum") / F.when(F.sum("records") > 0, F.sum("records"))).alias("mean_time"))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cell sums of all finished batches; one that was cut short has no status and doesn't count."""
    done = status(spark, folder).select(F.col("batch"))
    try:
        parts = spark.read.schema(SUMS + ", batch long").parquet(f"{folder}/cells")
    except AnalysisException:
        return spark.createDataFrame([], SUMS)
    return cell_sums(parts.join(F.broadcast(done), "batch", "left_semi"))


RUN = "channel long, pol long, u long, v long, first_row long, records long, weight double, re double, im double"
_STATE = "u long, v long, first_row long, records long, weight double, re double, im double"


def run_lengths(records: DataFrame) -> DataFrame:
    """Runs of records with equal (u, v) that follow each other in a channel and polarization, in the order of row_id, each summed into one row.

    Batches arrive in the order of their rows. Records of weight 0 are passed over and break no run. The last run of each channel and polarization is kept in the
    stream's state, so a run goes on over batches, and comes out when another begins.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        d = pd.concat(list(batches)).sort_values("row_id")
        d = d[d.weight != 0]
        out = []
        for r in d.itertuples():  # one row a record of the batch, as each may end a run
            if now is not None and (now[0], now[1]) == (r.u, r.v):
                now = [r.u, r.v, now[2], now[3] + 1, now[4] + r.weight, now[5] + r.re, now[6] + r.im]
            else:
                if now is not None:
                    out.append((*key, *now))
                now = [r.u, r.v, r.row_id, 1, r.weight, r.re, r.im]
        if now is not None:
            state.update(tuple(int(x) if i < 4 else float(x) for i, x in enumerate(now)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RUN.split(", ")])

    return records.groupBy("channel", "pol").applyInPandasWithState(step, RUN, _STATE, "append", GroupStateTimeout.NoTimeout)
