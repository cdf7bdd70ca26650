"""Feed angles: the parallactic angle of each antenna at each time, joined to samples twice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84 half axes in metres; sidereal angle at J2000 in degrees, its daily growth, and J2000 as MJD.
MAJOR, MINOR = 6378137.0, 6356752.314245
SIDEREAL, DAILY, J2000 = 280.46061837, 360.98564736629, 51544.5


def longitude_latitude(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Geodetic longitude and latitude of a place near the ground, by one step from the parametric latitude."""
    e2 = 1 - (MINOR / MAJOR) ** 2
    second = (MAJOR / MINOR) ** 2 - 1
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * MAJOR, p * MINOR)
    cube = lambda c: c * c * c
    return F.atan2(y, x), F.atan2(z + second * MINOR * cube(F.sin(t)), p - e2 * MAJOR * cube(F.cos(t)))


def hour_angle(mjd_seconds: Column, longitude: Column, ra: float) -> Column:
    """Mean sidereal time of a place less the right ascension, from days counted in two parts so that digits stay; times are after J2000."""
    days = mjd_seconds / 86400.0
    whole = F.floor(days)
    turns = SIDEREAL + (DAILY - 360.0) * (days - J2000) + 360.0 * (days - whole) + 180.0  # J2000 is at noon
    return turns % 360.0 * (math.pi / 180) + longitude - ra


def parallactic_angle(hour: Column, latitude: Column, dec: float) -> Column:
    return F.atan2(F.sin(hour), F.tan(latitude) * math.cos(dec) - math.sin(dec) * F.cos(hour))


def feed_angles(times: DataFrame, antennas: DataFrame, ra: float, dec: float, receptors: DataFrame | None = None) -> DataFrame:
    """(time, antenna, angle) of times (time, MJD seconds) and antennas (antenna_id, x, y, z), with each antenna's receptor angle (antenna_id, angle) added.

    A row for each pair; ``antennas`` are a telescope's, so sent to all tasks. An antenna without a receptor angle raises where it is looked up: it has no row.
    """
    places = antennas.select("antenna_id", *[c.alias(n) for c, n in zip(longitude_latitude(*map(F.col, "xyz")), ("longitude", "latitude"))])
    if receptors is not None:
        places = places.join(receptors.withColumnRenamed("angle", "receptor"), "antenna_id")
    added = F.col("receptor") if receptors is not None else F.lit(0.0)
    d = times.select("time").distinct().crossJoin(F.broadcast(places))
    angle = parallactic_angle(hour_angle(F.col("time"), F.col("longitude"), ra), F.col("latitude"), dec) + added
    return d.select("time", F.col("antenna_id").alias("antenna"), angle.alias("angle"))


def with_feed_angles(samples: DataFrame, angles: DataFrame) -> DataFrame:
    """``samples`` (time, antenna1, antenna2, ...) with feed_angle1 and feed_angle2."""
    for i in "12":
        samples = samples.join(angles.select("time", F.col("antenna").alias(f"antenna{i}"), F.col("angle").alias(f"feed_angle{i}")), ["time", f"antenna{i}"])
    return samples
