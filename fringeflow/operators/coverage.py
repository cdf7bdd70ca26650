"""Arcs that baselines draw in the uv plane while the Earth turns, and statistics of targets for a report."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feed import hour_angle

#: Intervals of this many seconds and more are halved, so that an arc goes less than half round.
LONGEST = 11 * 3600.0


def split_intervals(intervals: DataFrame, longest: float = LONGEST) -> DataFrame:
    """Rows (..., start, stop) halved until shorter than ``longest`` seconds."""
    whole = F.floor((F.col("stop") - F.col("start")) / longest)
    pieces = F.when(whole == 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(whole)).cast("double"))).cast("int")
    d = intervals.withColumn("_n", pieces).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    size = (F.col("stop") - F.col("start")) / F.col("_n")
    others = [c for c in intervals.columns if c not in ("start", "stop")]
    return d.select(*others, (F.col("start") + size * F.col("_k")).alias("start"), (F.col("start") + size * (F.col("_k") + 1)).alias("stop"))


def uvw_basis(hour: Column, dec: float) -> list[list[Column]]:
    """Rows u, v and w of a source at an hour angle and declination, over Earth-fixed X (meridian), Y (east) and Z (pole)."""
    s, c, sd, cd = F.sin(hour), F.cos(hour), math.sin(dec), math.cos(dec)
    return [[s, c, F.lit(0.0)], [-sd * c, sd * s, F.lit(cd)], [cd * c, -cd * s, F.lit(sd)]]


def null_vector(rows: list[list[Column]]) -> list[Column]:
    """The unit vector that a 3 x 3 matrix of rank 2, given by its rows, takes from the left to 0, in closed form: the largest cross product of two columns."""
    columns = [[rows[i][j] for i in range(3)] for j in range(3)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    found = [F.struct((v[0] ** 2 + v[1] ** 2 + v[2] ** 2).alias("size"), *[x.alias(f"c{i}") for i, x in enumerate(v)]) for v in (cross(columns[a], columns[b]) for a, b in ((0, 1), (0, 2), (1, 2)))]
    best = F.array_max(F.array(*found))
    return [best[f"c{i}"] / F.sqrt(best["size"]) for i in range(3)]


def arcs(intervals: DataFrame, antennas: DataFrame, longitude: float, ra: float, dec: float) -> DataFrame:
    """(antenna1, antenna2, start, u, v, major, minor, angle, angle0, angle1): a row for each interval (start, stop; MJD seconds) and pair of ``antennas``
    (antenna_id, x, y, z; metres from the array's centre, x to its meridian): the ellipse's centre, half axes (minor along ``angle``) and ends of the arc,
    in radians from its minor axis. Its mirror image is at (-u, -v).

    The Earth's axis is what two uvw bases an hour apart leave in place. Antennas are a telescope's, sent to all tasks, and pair by id.
    """
    d = split_intervals(intervals)
    here = lambda t: hour_angle(t, F.lit(longitude), ra)
    start, stop = F.col("start"), F.col("stop")
    first, later = uvw_basis(here(start), dec), uvw_basis(here(start + 3600.0), dec)
    axis = null_vector([[b - a for a, b in zip(p, q)] for p, q in zip(first, later)])
    d = d.withColumns({f"axis{i}": a for i, a in enumerate(axis)})
    d = d.withColumns({f"b{t}{i}{j}": x for t, basis in enumerate((first, uvw_basis(here(stop), dec))) for i, row in enumerate(basis) for j, x in enumerate(row)})
    end = lambda k: F.broadcast(antennas.select(F.col("antenna_id").alias(f"antenna{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]))
    pairs = end(1).join(end(2), F.col("antenna1") < F.col("antenna2"))
    d = d.crossJoin(F.broadcast(pairs))
    base = [F.col(c + "2") - F.col(c + "1") for c in "xyz"]
    d = d.withColumns({f"p{t}{i}": sum((F.col(f"b{t}{i}{j}") * base[j] for j in range(3)), F.lit(0.0)) for t in (0, 1) for i in range(3)})
    along = sum((F.col(f"p0{i}") * F.col(f"axis{i}") for i in range(3)), F.lit(0.0))
    d = d.withColumn("along", along).withColumns({f"mid{i}": F.col("along") * F.col(f"axis{i}") for i in range(3)})
    major = F.sqrt(sum(((F.col(f"p0{i}") - F.col(f"mid{i}")) ** 2 for i in range(3)), F.lit(0.0)))
    angle = F.atan2("axis1", "axis0")
    at = lambda t: F.atan2(F.col(f"p{t}1") - F.col("mid1"), F.col(f"p{t}0") - F.col("mid0"))
    d = d.withColumns({"major": major, "minor": F.abs("axis2") * major, "angle": angle, "a0": at(0), "a1": at(1)})
    long_way = F.pmod(F.col("a1") - F.col("a0"), F.lit(2 * math.pi)) >= math.pi
    low, high = F.when(long_way, F.col("a1")).otherwise(F.col("a0")), F.when(long_way, F.col("a0")).otherwise(F.col("a1"))
    return d.select("antenna1", "antenna2", "start", F.col("mid0").alias("u"), F.col("mid1").alias("v"), "major", "minor", "angle", (low - F.col("angle")).alias("angle0"), (high - F.col("angle")).alias("angle1"))
