"""Streams against the batch results: stopped, resumed, and with a batch that was cut short."""

import numpy as np
import pytest

from fringeflow.streaming import grid


def batches(n=4, rows=60):
    rng = np.random.default_rng(2)
    out, k = [], 0
    for _ in range(n):
        part = []
        for _ in range(rows):
            # places repeat, so that runs of several records occur, also over the edge of a batch
            part.append((k, float(k), k % 2, 0, int(k // 7 % 5), int(k // 14 % 3), float(rng.integers(0, 4)), float(rng.integers(-9, 9)), float(rng.integers(-9, 9))))
            k += 1
        out.append(part)
    return out


def add(spark, rows, path):
    spark.createDataFrame(rows, grid.RECORDS).coalesce(1).write.mode("append").parquet(path)


def sums(df):
    return sorted(map(tuple, df.select("channel", "pol", "u", "v", "weight", "re", "im").collect()))


def test_a_stopped_stream_goes_on(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "grid")
    parts = batches()
    assert grid.cells(spark, folder).count() == 0 and grid.progress(spark, folder).first().records == 0
    stream = lambda: spark.readStream.schema(grid.RECORDS).option("maxFilesPerTrigger", 1).parquet(source)
    for k, part in enumerate(parts):
        add(spark, part, source)
        if k % 2:  # a new query each time, as after a stop
            grid.grid_into(stream(), folder).awaitTermination()
            whole = spark.createDataFrame([r for p in parts[: k + 1] for r in p], grid.RECORDS)
            assert sums(grid.cells(spark, folder)) == sums(grid.cell_sums(whole))
    got = grid.progress(spark, folder).first()
    assert (got.batches, got.records) == (4, 240) and got.mean_time == pytest.approx(119.5)


def test_a_batch_without_status_does_not_count(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "grid")
    parts = batches(2)
    add(spark, parts[0], source)
    grid.grid_into(spark.readStream.schema(grid.RECORDS).parquet(source), folder).awaitTermination()
    # the next batch died between its cells and its status; it is run again and overwrites them
    grid.cell_sums(spark.createDataFrame(parts[1][:10], grid.RECORDS)).write.parquet(f"{folder}/cells/batch=1")
    assert sums(grid.cells(spark, folder)) == sums(grid.cell_sums(spark.createDataFrame(parts[0], grid.RECORDS)))
    add(spark, parts[1], source)
    grid.grid_into(spark.readStream.schema(grid.RECORDS).parquet(source), folder).awaitTermination()
    assert sums(grid.cells(spark, folder)) == sums(grid.cell_sums(spark.createDataFrame(parts[0] + parts[1], grid.RECORDS)))


def test_running_sums(spark, tmp_path):
    source = str(tmp_path / "in")
    parts = batches(2)
    for p in parts:
        add(spark, p, source)
    query = grid.grid_stream(spark, source).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sums(spark.table("running")) == sums(grid.cell_sums(spark.createDataFrame(parts[0] + parts[1], grid.RECORDS)))


def plain_runs(rows):
    out, now = [], {}
    for row_id, _, c, p, u, v, weight, re, im in rows:
        if weight == 0:
            continue
        run = now.get((c, p))
        if run and run[:2] == [u, v]:
            now[c, p] = [u, v, run[2], run[3] + 1, run[4] + weight, run[5] + re, run[6] + im]
        else:
            if run:
                out.append((c, p, *run))
            now[c, p] = [u, v, row_id, 1, weight, re, im]
    return sorted(out)


def test_runs_go_on_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    parts = batches(3, 47)
    out = str(tmp_path / "out")
    for p in parts:  # one batch after the other, a new query each
        add(spark, p, source)
        query = grid.run_lengths(spark.readStream.schema(grid.RECORDS).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == plain_runs([r for p in parts for r in p])
