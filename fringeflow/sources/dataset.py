"""Datasets: loaders by path, a catalogue of tables each, and one plan of samples.

A sample is a row (row_id, channel, time, antenna1, antenna2, u, v, w, re, im, weight) with an array entry a polarization. Tables are Parquet folders; lengths,
angles and frequencies are brought to m, rad and Hz by the ``unit`` that a column's metadata names.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .visibility import channel_range

#: Units by kind, as multiples of the one that is used.
UNITS = {
    "length": {"m": 1.0, "km": 1e3, "cm": 1e-2, "mm": 1e-3},
    "angle": {"rad": 1.0, "deg": math.pi / 180, "arcmin": math.pi / 10800, "arcsec": math.pi / 648000},
    "frequency": {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9},
    "time": {"s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0},
}
#: MJD seconds of 1970-01-01.
MJD_1970 = 40587 * 86400.0


def in_unit(df: DataFrame, column: str, kind: str) -> Column:
    """``column``, a number or an array of numbers, in the unit of its ``kind``; taken as it is where its metadata names none. ValueError for units of another kind."""
    unit = df.schema[column].metadata.get("unit")
    if unit is None:
        return F.col(column)
    if unit not in UNITS[kind]:
        raise ValueError(f"{column} is in {unit}, which is no {kind}")
    ratio = UNITS[kind][unit]
    if df.schema[column].dataType.typeName() == "array":
        return F.transform(column, lambda x: x * ratio).alias(column)
    return (F.col(column) * ratio).alias(column)


def iso_time(seconds: Column, mjd: bool = True) -> Column:
    """UTC ISO text of MJD or UNIX seconds, to the millisecond."""
    micros = F.round((seconds - (MJD_1970 if mjd else 0.0)) * 1e3).cast("long")
    whole = F.date_format(F.timestamp_seconds(F.floor(micros / 1000)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(micros, F.lit(1000)).cast("string"), 3, "0"))


def direction_text(ra: Column, dec: Column) -> Column:
    """``ra, dec`` in degrees with ten decimals."""
    return F.format_string("%.10f, %.10f", F.degrees(ra), F.degrees(dec))


class Dataset(ABC):
    """A dataset that a loader opened. ``options`` are texts by name; unknown ones raise ValueError."""

    OPTIONS: tuple[str, ...] = ()
    TABLES: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, path: str, options: dict | None = None, start_channel: int = 0, stop_channel: int | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), dict(options or {})
        unknown = set(self.options) - set(self.OPTIONS)
        if unknown:
            raise ValueError(f"no options named {sorted(unknown)}; there are {list(self.OPTIONS)}")
        self.start, self.stop = channel_range({"start_channel": start_channel, "stop_channel": stop_channel})

    @classmethod
    @abstractmethod
    def match(cls, path: str) -> bool: ...

    @abstractmethod
    def samples(self) -> DataFrame: ...

    @abstractmethod
    def frequencies(self) -> DataFrame:
        """(channel, frequency) in Hz."""

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def antennas(self) -> DataFrame:
        """(antenna_id, name, x, y, z, diameter) in metres."""
        d = self.table("antenna")
        position, dish = in_unit(d, "position", "length").alias("p"), in_unit(d, "dish_diameter", "length").alias("diameter")
        return d.select("antenna_id", "name", position, dish).select("antenna_id", "name", *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")], "diameter")

    def wavelengths(self) -> DataFrame:
        return self.frequencies().select("channel", (299792458.0 / F.col("frequency")).alias("wavelength"))

    def in_range(self) -> Column:
        c = F.col("channel") >= self.start
        return c & (F.col("channel") < self.stop) if self.stop is not None else c

    def limited(self, rows: int) -> DataFrame:
        """The samples of the first ``rows`` rows in the order of row_id: whole rows, with all that belongs to them."""
        d = self.samples()
        return d.join(F.broadcast(d.select("row_id").distinct().orderBy("row_id").limit(rows)), "row_id", "left_semi")


LOADERS: list[type[Dataset]] = []


def register(loader: type[Dataset]) -> type[Dataset]:
    LOADERS.append(loader)
    return loader


def load(spark: SparkSession, path: str, options: dict | None = None, start_channel: int = 0, stop_channel: int | None = None) -> Dataset:
    """The dataset at ``path``, by the first registered loader that takes it; ValueError if none does."""
    for loader in LOADERS:
        if loader.match(path):
            return loader(spark, path, options, start_channel, stop_channel)
    raise ValueError(f"no loader takes {path}")


def by_baseline(samples: DataFrame, antennas: int) -> DataFrame:
    """``samples`` with ``baseline`` (antenna1 x antennas + antenna2), each channel's together, in the order of baseline and then time: as records compress best."""
    d = samples.withColumn("baseline", F.col("antenna1") * antennas + F.col("antenna2"))
    return d.repartition("channel").sortWithinPartitions("channel", "baseline", "time")


def load_antennas(spark: SparkSession, path: str) -> DataFrame:
    """(name, diameter, east, north, up) of a text file with a line ``name, latitude, longitude, altitude, diameter, east north up ...`` an antenna; blank lines and
    comments go."""
    field = F.split("value", r"\s*,\s*")
    at = lambda i: F.trim(F.get(field, F.lit(i)))
    place = F.transform(F.split(at(5), r"\s+"), lambda x: x.try_cast("double"))
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(at(0).alias("name"), at(4).try_cast("double").alias("diameter"), *[F.get(place, F.lit(i)).alias(c) for i, c in enumerate(("east", "north", "up"))])


#: Receiver bands that have a model of the primary beam.
BEAM_BANDS = ("L", "UHF")


def load_beam(spark: SparkSession, path: str, band: str) -> tuple[DataFrame, float]:
    """The primary beam (frequency, radius, voltage) of a band and its step (sine of an angle), of the table ``path`` (band, step, frequency, radius, voltage)."""
    if band not in BEAM_BANDS:
        raise ValueError(f"no primary beam of band {band}; there are {BEAM_BANDS}")
    d = spark.read.parquet(path).where(F.col("band") == band)
    steps = [r["step"] for r in d.select("step").distinct().limit(2).collect()]
    if len(steps) != 1:
        raise ValueError(f"the beam of band {band} has {'several steps' if steps else 'no rows'}")
    return d.select(in_unit(d, "frequency", "frequency"), "radius", "voltage"), steps[0]


def longest_baseline(antennas: DataFrame) -> float:
    """Largest distance of two antennas (x, y, z); one row a pair of a telescope's antennas, some thousands at most, raised where more."""
    few = antennas.select("x", "y", "z").limit(1 << 14).collect()
    if len(few) == 1 << 14:
        raise ValueError("more antennas than a telescope has")
    p, q = antennas.select(*[F.col(c).alias(c + "1") for c in "xyz"]), antennas.select("x", "y", "z")
    square = sum((F.col(c + "1") - F.col(c)) ** 2 for c in "xyz")
    return p.join(F.broadcast(q), F.col("x1") <= F.col("x")).agg(F.max(F.sqrt(square))).first()[0] or 0.0


@register
class MeasurementSet(Dataset):
    """Tables of a measurement set: main (by channel), antenna, field, data_description, spectral_window, polarization, feed, observation.

    Options: ``data``, the visibility column; ``field`` and ``data_desc``, ids; ``pol_frame``, sky or feed; ``uvw``, casa (signs turned) or strict.
    """

    OPTIONS = ("data", "field", "data_desc", "pol_frame", "uvw")

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        get = self.options.get
        self.data, self.field, self.data_desc = get("data", "data"), int(get("field", 0)), int(get("data_desc", 0))
        for option, allowed in (("pol_frame", ("sky", "feed")), ("uvw", ("casa", "strict"))):
            if get(option, allowed[0]) not in allowed:
                raise ValueError(f"{option} is one of {allowed}")
        self.strict, self.feed_frame = get("uvw") == "strict", get("pol_frame") == "feed"
        self.main = self.table("main")
        if self.data not in self.main.columns:
            raise ValueError(f"{self.path} has no column named {self.data}")
        for name, wanted, table in (("field_id", self.field, "field"), ("data_desc_id", self.data_desc, "data_description")):
            if not self.table(table).where(F.col(name) == wanted).limit(1).count():
                raise ValueError(f"{name} {wanted} is out of range")

    @classmethod
    def match(cls, path: str) -> bool:
        return path.rstrip("/").lower().endswith(".ms")

    def _described(self, table: str, key: str) -> DataFrame:
        """The row of ``table`` that the data description points to."""
        chosen = self.table("data_description").where(F.col("data_desc_id") == self.data_desc)
        return self.table(table).join(F.broadcast(chosen.select(key)), key)

    def frequencies(self) -> DataFrame:
        d = self._described("spectral_window", "spectral_window_id")
        return d.select(F.posexplode(in_unit(d, "chan_freq", "frequency")).alias("channel", "frequency")).where(self.in_range())

    def band(self) -> str | None:
        name = self._described("spectral_window", "spectral_window_id").first()["name"]
        return None if not name or name.lower() == "none" else name

    def polarizations(self) -> list[str]:
        return list(self._described("polarization", "polarization_id").first()["corr_type"])

    def phase_centre(self) -> tuple[float, float]:
        d = self.table("field").where(F.col("field_id") == self.field)
        ra, dec = d.select(in_unit(d, "phase_dir", "angle")).first()[0]
        return ra, dec

    def receptor_angles(self) -> DataFrame:
        """(antenna_id, angle): the one receptor angle of each antenna; ValueError where there are several."""
        d = self.table("feed")
        each = d.select("antenna_id", F.explode(in_unit(d, "receptor_angle", "angle")).alias("angle")).groupBy("antenna_id").agg(F.min("angle").alias("angle"), F.max("angle").alias("most"))
        if each.where(F.col("most") - F.col("angle") > 1e-8).limit(1).count():
            raise ValueError("several feed angles for one antenna")
        return each.drop("most")

    def kept(self) -> DataFrame:
        """Rows that are imaged: of the field and data description, not flagged as a whole, between two antennas, of the channels asked for."""
        return self.main.where((F.col("field_id") == self.field) & (F.col("data_desc_id") == self.data_desc) & ~F.col("flag_row") & (F.col("antenna1") != F.col("antenna2")) & self.in_range())

    def samples(self) -> DataFrame:
        d = self.kept()
        sign = 1.0 if self.strict else -1.0
        uvw = in_unit(self.main, "uvw", "length")
        weight = F.coalesce("weight_spectrum", "weight") if "weight_spectrum" in d.columns else F.col("weight")
        return d.withColumn("uvw", uvw).select(
            "row_id", "channel", "time", "antenna1", "antenna2", *[(F.col("uvw")[i] * sign).alias(c) for i, c in enumerate("uvw")],
            F.col(f"{self.data}.re").alias("re"), F.col(f"{self.data}.im").alias("im"), F.zip_with(weight, "flag", lambda w, f: F.when(f, 0.0).otherwise(w)).alias("weight"),
        )

    def headers(self) -> DataFrame:
        """One row: date_avg, the mean of the distinct times that are imaged, as ISO text; mean antenna position; observer and telescope if there is just one observation."""
        kept = self.kept()
        time = kept.select("time").distinct().agg(iso_time(F.avg("time")).alias("date_avg"))
        place = self.antennas().agg(*[F.avg(c).alias(f"obsgeo_{c}") for c in "xyz"])
        ids = kept.select("observation_id").distinct()
        only = ids.agg(F.when(F.count("*") == 1, F.max("observation_id")).alias("observation_id"))
        named = only.join(self.table("observation"), "observation_id", "left").select("observer", "telescope")
        return time.crossJoin(place).crossJoin(named)  # one row each


@register
class Archive(Dataset):
    """Tables of an archive: vis (a row a dump, channel and correlation product), corr_products, antenna, channels, targets, scans, masks.

    Options: ``target``, an index, name or alias. Without it the first target tagged target, else the first that is no calibrator, else the first.
    """

    OPTIONS = ("target",)
    #: Order of polarization products.
    POLS = ("hh", "hv", "vh", "vv")

    @classmethod
    def match(cls, path: str) -> bool:
        try:
            url = urlparse(path)
        except ValueError:
            return False
        return url.scheme == "redis" or url.path.rstrip("/").endswith(".rdb")

    def target(self) -> dict:
        """The row (target_id, name, aliases, tags, ra, dec) that is imaged; ValueError if the option names none."""
        d, wanted = self.table("targets"), self.options.get("target")
        if wanted is None:
            tags = F.col("tags")
            rank = F.when(F.array_contains(tags, "target"), 0).when(~F.arrays_overlap(tags, F.array(F.lit("bpcal"), F.lit("gaincal"))), 1).otherwise(2)
            got = d.orderBy(rank, "target_id").first()
        elif str(wanted).isdigit():
            got = d.where(F.col("target_id") == int(wanted)).first()
        else:
            got = d.where((F.col("name") == wanted) | F.array_contains("aliases", wanted)).orderBy("target_id").first()
        if got is None:
            raise ValueError(f"no target {wanted}")
        return got.asDict()

    def dumps(self) -> DataFrame:
        """(dump, time) of the target while the antennas track it."""
        return self.table("scans").where((F.col("state") == "track") & (F.col("target_id") == self.target()["target_id"])).select("dump", "time")

    def frequencies(self) -> DataFrame:
        return self.table("channels").where(self.in_range()).select("channel", in_unit(self.table("channels"), "frequency", "frequency"))

    def enabled(self) -> DataFrame:
        """(channel, enabled): channels outside all ranges (low, high) of masks. A range holds both its ends."""
        f, masks = self.frequencies(), self.table("masks").select("low", "high")
        bad = f.join(F.broadcast(masks), (F.col("frequency") >= F.col("low")) & (F.col("frequency") <= F.col("high")), "left_semi").select("channel", F.lit(False).alias("enabled"))
        return f.select("channel").join(bad, "channel", "left").select("channel", F.coalesce("enabled", F.lit(True)).alias("enabled"))

    def slots(self) -> DataFrame:
        """(antenna1, antenna2, pol, product): a slot for each baseline that has any cross product and each polarization; ``product`` is null where it is missing.
        ValueError for inputs of antennas that aren't there."""
        split = self.table("corr_products").select("product", *[x for i in "12" for x in (F.expr(f"substr(input{i}, 1, length(input{i}) - 1)").alias(f"name{i}"), F.right(f"input{i}", F.lit(1)).alias(f"feed{i}"))])
        names = self.antennas().select("antenna_id", "name")
        unknown = split.select(F.explode(F.array("name1", "name2")).alias("name")).distinct().join(F.broadcast(names), "name", "left_anti")
        if bad := [r["name"] for r in unknown.limit(5).collect()]:
            raise ValueError(f"no antennas named {bad}")
        one = lambda i: F.broadcast(names.select(F.col("antenna_id").alias(f"antenna{i}"), F.col("name").alias(f"name{i}")))
        known = split.join(one(1), "name1").join(one(2), "name2").where("antenna1 <> antenna2").select("antenna1", "antenna2", F.concat("feed1", "feed2").alias("pair"), "product")
        pols = self.spark.createDataFrame([(p, i) for i, p in enumerate(self.POLS)], "pair string, pol int")
        return known.select("antenna1", "antenna2").distinct().crossJoin(F.broadcast(pols)).join(known, ["antenna1", "antenna2", "pair"], "left").select("antenna1", "antenna2", "pol", "product")

    def samples(self) -> DataFrame:
        """Missing products have value and weight 0, as have flagged ones and those of masked channels, so that what needs all polarizations leaves them out."""
        vis = self.table("vis").where(self.in_range()).join(F.broadcast(self.dumps()), "dump")
        slots = self.slots()
        used = vis.join(F.broadcast(slots.where("product is not null")), "product")
        entry = F.struct("pol", "re", "im", F.when(F.col("flag"), 0.0).otherwise(F.col("weight")).alias("weight"))
        each = used.groupBy("dump", "time", "channel", "antenna1", "antenna2").agg(F.map_from_entries(F.collect_list(F.struct("pol", entry))).alias("by_pol"))  # at most an entry a polarization
        antennas = self.table("uvw").select("dump", "antenna_id", *"uvw")
        end = lambda i: antennas.select("dump", F.col("antenna_id").alias(f"antenna{i}"), *[F.col(c).alias(f"{c}{i}") for c in "uvw"])
        d = each.join(end(1), ["dump", "antenna1"]).join(end(2), ["dump", "antenna2"]).join(F.broadcast(self.enabled()), "channel")
        value = lambda c: F.transform(F.sequence(F.lit(0), F.lit(len(self.POLS) - 1)), lambda p: F.coalesce(F.try_element_at("by_pol", p)[c], F.lit(0.0)))
        weight = F.when(F.col("enabled"), value("weight")).otherwise(F.array_repeat(F.lit(0.0), len(self.POLS)))
        row = F.xxhash64("dump", "antenna1", "antenna2")
        return d.select(row.alias("row_id"), "channel", "time", "antenna1", "antenna2", *[(F.col(c + "2") - F.col(c + "1")).alias(c) for c in "uvw"], value("re").alias("re"), value("im").alias("im"), weight.alias("weight"))
