"""The report of a run: statistics of targets by channel, time on target, metadata, and pages of them."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sefd import SefdModel, thermal_noise
from .feed import hour_angle, longitude_latitude, parallactic_angle

VALUES = ("peak", "noise", "weights_noise", "normalized_noise")


def on_target(scans: DataFrame, dump_period: float) -> DataFrame:
    """(target_id, seconds, hours) tracked, of dumps (dump, time, state, target_id)."""
    tracked = scans.where("state = 'track'").groupBy("target_id").agg((F.count("*") * dump_period).alias("seconds"))
    return tracked.withColumn("hours", F.col("seconds") / 3600)


def intervals(scans: DataFrame, dump_period: float) -> DataFrame:
    """(target_id, start, stop): runs of dumps one after the other on a target, half a dump longer at both ends.

    Dumps count from 0 without gaps, so in a run the dump less its place among the target's is the same.
    """
    placed = scans.where("state = 'track'").withColumn("run", F.col("dump") - F.row_number().over(Window.partitionBy("target_id").orderBy("dump")))
    return placed.groupBy("target_id", "run").agg((F.min("time") - dump_period / 2).alias("start"), (F.max("time") + dump_period / 2).alias("stop")).drop("run")


def channel_statistics(channels: DataFrame, output: DataFrame, status: DataFrame, statistics: DataFrame, target: int | str, sefd: SefdModel | None = None, antennas: int = 0, seconds: float = 0.0) -> DataFrame:
    """A row for each of ``channels`` (channel, frequency, width): status, peak, noises, total flux of each polarization and the model's natural noise; NaN where missing.

    ``output`` (channel) was to be imaged: its channels without ``status`` (target, channel, status) failed, others without are masked. ``statistics`` has (target,
    channel, pol, ...).
    """
    mine = lambda d: d.where(F.col("target") == target).drop("target")
    nan = F.lit(float("nan"))
    totals = mine(statistics).groupBy("channel").pivot("pol", ["I", "Q", "U", "V"]).agg(F.first("total")).select("channel", *[F.col(p).alias(f"total_{p}") for p in "IQUV"])
    values = mine(statistics).groupBy("channel").agg(*[F.first(v, ignorenulls=True).alias(v) for v in VALUES])
    d = channels.join(output.select("channel", F.lit(True).alias("wanted")), "channel", "left").join(mine(status), "channel", "left").join(values, "channel", "left").join(totals, "channel", "left")
    named = F.coalesce("status", F.when(F.col("wanted"), "failed").otherwise("masked"))
    model = thermal_noise(sefd.at(F.col("frequency"), True), antennas, F.lit(float(seconds)), F.col("width")) if sefd is not None else F.lit(None).cast("double")
    filled = [F.coalesce(c, nan).alias(c) for c in (*VALUES, *[f"total_{p}" for p in "IQUV"])]
    return d.select("channel", "frequency", named.alias("status"), *filled, F.coalesce(model, nan).alias("model_noise"))


def pointing(times: DataFrame, x: float, y: float, z: float, ra: float, dec: float) -> DataFrame:
    """(time, elevation, parallactic) in radians of a direction from a place (metres from the Earth's centre) at times (time, MJD seconds)."""
    longitude, latitude = longitude_latitude(F.lit(x), F.lit(y), F.lit(z))
    hour = hour_angle(F.col("time"), longitude, ra)
    up = F.sin(latitude) * math.sin(dec) + F.cos(latitude) * math.cos(dec) * F.cos(hour)
    return times.select("time", F.asin(up).alias("elevation"), parallactic_angle(hour, latitude, dec).alias("parallactic"))


def counts(rows: DataFrame) -> DataFrame:
    """(status, channels), and a row of all for status null."""
    return rows.rollup("status").agg(F.count("*").alias("channels"))


def si(value: Column, unit: str, digits: int = 3) -> Column:
    """``value`` with the SI prefix that leaves 1 to 1000 of it: for instance 12.3 mJy."""
    prefixes = {-4: "p", -3: "n", -2: "µ", -1: "m", 0: "", 1: "k", 2: "M", 3: "G", 4: "T"}
    power = F.when(value == 0, 0).otherwise(F.greatest(F.least(F.floor(F.log10(F.abs(value)) / 3 + 1e-12), F.lit(4)), F.lit(-4)))
    name = F.element_at(F.create_map(*[F.lit(x) for p in prefixes.items() for x in p]), power.cast("int"))
    return F.concat(F.format_string(f"%.{digits}g", value / F.pow(F.lit(1000.0), power)), F.lit(" "), name, F.lit(unit))


def metadata(targets: DataFrame, parameters: dict, channels: int, width: float, seconds: DataFrame, description: str, start: str) -> dict:
    """What describes a run: ``parameters`` of the observation (unknown ones are UNKNOWN) and its ``targets`` (target_id, name, description, ra, dec), a row each."""
    get = lambda key: parameters.get(key, "UNKNOWN")
    rows = targets.join(seconds, "target_id", "left").orderBy("target_id").select("*", F.format_string("%.10f,%.10f", F.degrees("dec"), F.degrees("ra")).alias("text")).collect()
    return {
        "CaptureBlockId": get("capture_block_id"), "ScheduleBlockIdCode": get("sb_id_code"), "Description": f"{get('description')}: {description}", "ProposalId": get("proposal_id"), "Observer": get("observer"),
        "StartTime": start + "Z", "Bandwidth": width * channels, "ChannelWidth": width, "NumFreqChannels": channels, "DecRa": [r["text"] for r in rows], "Targets": [r["name"] for r in rows],
        "TargetDescriptions": [r["description"] for r in rows], "IntegrationTime": [(r["seconds"] or 0.0) / 3600 for r in rows],
    }


def as_json(about: dict) -> str:
    """JSON without NaN: ValueError where a value isn't finite."""
    return json.dumps(about, allow_nan=False, indent=2)


def page(title: str, tables: dict[str, DataFrame], rows: int = 1 << 16) -> str:
    """An HTML page of small tables by heading: counts, channels. ValueError for one of more than ``rows`` rows."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for heading, d in tables.items():
        found = d.limit(rows + 1).collect()
        if len(found) > rows:
            raise ValueError(f"{heading} has more than {rows} rows")
        cell = lambda kind, x: f"<{kind}>{html.escape('' if x is None else str(x))}</{kind}>"
        lines = ["".join(cell("th", c) for c in d.columns), *("".join(cell("td", x) for x in r) for r in found)]
        out.append(f"<h2>{html.escape(heading)}</h2><table>{''.join(f'<tr>{x}</tr>' for x in lines)}</table>")
    return "".join(out) + "</body></html>"
