"""A Spark data source of visibilities kept as Parquet folders by channel: ``spark.read.format("visibility")``.

A partition of the scan is a row group of one channel's file; options and pushed filters choose channels by folder and row groups by their statistics
before a task starts. Rows are sent as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "row_id long, time double, antenna1 int, antenna2 int, field_id int, data_desc_id int, observation_id int, flag_row boolean, uvw array<double>, data array<struct<re double, im double>>, flag array<boolean>, weight array<double>, channel int"
#: Columns whose filters are taken over; the rest stay with Spark.
PUSHED = ("channel", "field_id", "data_desc_id", "flag_row", "antenna1", "antenna2")
_COMPARE = {EqualTo: lambda c, v: c == v, GreaterThan: lambda c, v: c > v, GreaterThanOrEqual: lambda c, v: c >= v, LessThan: lambda c, v: c < v, LessThanOrEqual: lambda c, v: c <= v, In: lambda c, v: c.isin(list(v))}


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int
    channel: int


def channel_range(options: dict) -> tuple[int, int | None]:
    """start_channel and stop_channel, half open; ValueError for others than 0 <= start < stop."""
    start = int(options.get("start_channel") or 0)
    stop = options.get("stop_channel")
    stop = None if stop in (None, "") else int(stop)
    if start < 0 or stop is not None and stop <= start:
        raise ValueError(f"channels from {start} to {stop}: the range is empty or negative")
    return start, stop


class VisibilityReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path, self.data = options["path"].rstrip("/"), options.get("data") or "data"
        start, stop = channel_range(options)
        chosen = [ds.field("channel") >= start] + ([ds.field("channel") < stop] if stop is not None else [])
        for option, column, table, ids in (("field", "field_id", "field", "field_id"), ("data_desc", "data_desc_id", "data_description", "data_desc_id")):
            if options.get(option):
                known, wanted = self._table(table).column(ids).to_pylist(), int(options[option])
                if wanted not in known:
                    raise ValueError(f"{option} {wanted} is out of range")
                chosen.append(ds.field(column) == wanted)
        self.filters = chosen
        if self.data not in self._main().schema.names:
            raise ValueError(f"{self.path} has no column named {self.data}")

    def _table(self, name: str) -> pa.Table:
        return ds.dataset(f"{self.path}/{name}", format="parquet").to_table()

    def _main(self) -> ds.Dataset:
        return ds.dataset(f"{self.path}/main", format="parquet", partitioning=ds.partitioning(pa.schema([("channel", pa.int32())]), flavor="hive"))

    def _where(self) -> ds.Expression:
        out = self.filters[0]
        for f in self.filters[1:]:
            out = out & f
        return out

    def partitions(self) -> list[RowGroup]:
        found = []
        for fragment in self._main().get_fragments(filter=self._where()):
            channel = ds.get_partition_keys(fragment.partition_expression)["channel"]
            for part in fragment.split_by_row_group(filter=self._where(), schema=self._main().schema):
                found += [RowGroup(part.path, g.id, channel) for g in part.row_groups]
        return found or [RowGroup("", 0, -1)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        if partition.channel < 0:  # nothing was left to read
            return
        main = self._main()
        whole = main.format.make_fragment(partition.path, main.filesystem, partition_expression=ds.field("channel") == partition.channel)
        part = whole.subset(row_group_ids=[partition.group])
        columns = [c.split()[0] for c in SCHEMA.replace("struct<re double, im double>", "struct").split(", ")]
        target = pa.schema([("re", pa.float64()), ("im", pa.float64())])
        for batch in part.to_batches(schema=main.schema, filter=self._where(), columns=[self.data if c == "data" else c for c in columns if c != "channel"]):
            data = batch.column(self.data).cast(pa.list_(pa.struct(list(target))))
            arrays = [data if c == "data" else pa.array([partition.channel] * batch.num_rows, pa.int32()) if c == "channel" else batch.column(c) for c in columns]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pc.cast(a, pa.list_(pa.float64())) if c in ("uvw", "weight") else a for c, a in zip(columns, arrays)], columns)


class PushingReader(VisibilityReader):
    """Takes over a query's filters of the columns PUSHED."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _COMPARE and name in PUSHED:
                self.filters.append(_COMPARE[type(f)](ds.field(name), f.value))
            else:
                yield f


class VisibilitySource(DataSource):
    """Options: path, start_channel, stop_channel, field, data_desc, data (name of the visibility column), and push_filters.

    With push_filters the query's own filters prune too; the session must set ``spark.sql.python.filterPushdown.enabled``. Spark 4.1 keeps the filters of a
    DataFrame's first query for its later ones, so with it each query needs a ``load`` of its own. The other options need no such care.
    """

    @classmethod
    def name(cls) -> str:
        return "visibility"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VisibilityReader:
        options = dict(self.options)
        return (PushingReader if options.get("push_filters", "").lower() == "true" else VisibilityReader)(options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(VisibilitySource)
