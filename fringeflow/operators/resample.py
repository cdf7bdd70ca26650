"""Images resampled: through world coordinates onto another image's pixels, and from squares to circles.

A wanted point meets the four pixels around it by an equi-join on (image, tile, y, x); no pixel meets all others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256


@dataclass(frozen=True)
class World:
    """Orthographic world coordinates of an image: centre pixel (y0, x0), pixel steps (sines of angles; the x step is negative where RA grows to the left), and the
    direction of the centre in radians."""

    y0: float
    x0: float
    step_y: float
    step_x: float
    ra: float
    dec: float

    def to_world(self, y: Column, x: Column) -> tuple[Column, Column]:
        """RA and declination of a pixel; NaN beyond the horizon."""
        l, m = (x - self.x0) * self.step_x, (y - self.y0) * self.step_y  # noqa: E741
        n2 = 1 - l * l - m * m
        n = F.when(n2 >= 0, F.sqrt(F.greatest(n2, F.lit(0.0)))).otherwise(math.nan)
        sd, cd = math.sin(self.dec), math.cos(self.dec)
        return F.atan2(l, n * cd - m * sd) + self.ra, F.asin(m * cd + n * sd)

    def to_pixel(self, ra: Column, dec: Column) -> tuple[Column, Column]:
        """y and x of a direction; NaN for those behind."""
        sd, cd = math.sin(self.dec), math.cos(self.dec)
        turn = ra - self.ra
        l, m = F.cos(dec) * F.sin(turn), F.sin(dec) * cd - F.cos(dec) * F.cos(turn) * sd  # noqa: E741
        front = F.sin(dec) * sd + F.cos(dec) * F.cos(turn) * cd >= 0
        seen = lambda c: F.when(front, c).otherwise(math.nan)
        return seen(m / self.step_y + self.y0), seen(l / self.step_x + self.x0)


def bilinear(points: DataFrame, pixels: DataFrame, image: list[str], values: list[str], tile: int = TILE) -> DataFrame:
    """``points`` (image columns, y, x fractional, ...) with each of ``values`` of ``pixels`` (image columns, y, x whole, values) between the four pixels around.

    A point that has no weight on a pixel doesn't need it, so the last row and column count as inside; null where a pixel that is needed is missing, is null or NaN,
    and for points that are NaN. Points are told apart by all their columns: equal ones come out once.
    """
    keyed = points.withColumns({"_y": F.floor("y"), "_x": F.floor("x")})
    corners = F.array(*[F.struct((F.col("_y") + dy).alias("y"), (F.col("_x") + dx).alias("x"), ((F.col("y") - F.col("_y") if dy else F.lit(1.0) - (F.col("y") - F.col("_y"))) * (F.col("x") - F.col("_x") if dx else F.lit(1.0) - (F.col("x") - F.col("_x")))).alias("share")) for dy in (0, 1) for dx in (0, 1)])
    used = keyed.withColumn("_corner", F.explode_outer(F.when(~F.isnan("y") & ~F.isnan("x"), F.filter(corners, lambda c: c["share"] > 0))))
    at = used.select(*image, *[F.col(c).alias("_p_" + c) for c in points.columns], F.col("_corner.y").alias("_cy"), F.col("_corner.x").alias("_cx"), F.col("_corner.share").alias("_share"))
    band = lambda c: F.floor(F.col(c) / tile)
    there = pixels.select(*image, F.col("y").alias("_cy"), F.col("x").alias("_cx"), *[F.col(v).cast("double").alias("_v_" + v) for v in values]).withColumns({"_ty": band("_cy"), "_tx": band("_cx")})
    met = at.withColumns({"_ty": band("_cy"), "_tx": band("_cx")}).join(there, [*image, "_ty", "_tx", "_cy", "_cx"], "left")
    whole = lambda v: F.when(F.min(F.when(F.col(v).isNotNull() & ~F.isnan(v), 1).otherwise(0)) == 1, F.sum(F.col(v) * F.col("_share")))
    out = met.groupBy(*["_p_" + c for c in points.columns]).agg(*[whole("_v_" + v).alias("_o_" + v) for v in values])
    return out.select(*[F.col("_p_" + c).alias(c) for c in points.columns], *[F.col("_o_" + v).alias(v) for v in values])


def regrid(source: DataFrame, target: DataFrame, source_world: World, target_world: World) -> DataFrame:
    """(img, y, x, value, other): each pixel of ``target`` (img, y, x, value) with what ``source`` has in that direction, null outside it; rows of a target are
    distinct pixels. Their difference is other - value."""
    sy, sx = source_world.to_pixel(*target_world.to_world(F.col("y"), F.col("x")))
    points = target.select("img", F.col("y").alias("row"), F.col("x").alias("column"), "value", sy.alias("y"), sx.alias("x"))
    got = bilinear(points, source.withColumnRenamed("value", "other"), ["img"], ["other"])
    return got.select("img", F.col("row").alias("y"), F.col("column").alias("x"), "value", "other")


def circularise(beam: DataFrame, centre: float, radii: int, angles: int = 64) -> DataFrame:
    """(frequency, radius, voltage): beams (frequency, pol, y, x, re, im) on squares, ``centre`` the middle's pixel, sampled on ``radii`` circles a pixel apart at
    ``angles`` points each, and their power averaged over the points, halved over the polarizations, as a voltage.

    A circle that leaves the square has no voltage.
    """
    each = beam.select("frequency", "pol").distinct()
    circle = each.withColumn("radius", F.explode(F.sequence(F.lit(0), F.lit(radii - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))))
    angle = F.col("k") * (2 * math.pi / angles)
    exact = lambda c: F.round(c, 9)  # a point on a pixel is on it
    points = circle.withColumns({"y": exact(F.col("radius") * F.sin(angle) + centre), "x": exact(F.col("radius") * F.cos(angle) + centre)})
    got = bilinear(points, beam, ["frequency", "pol"], ["re", "im"])
    power = got.groupBy("frequency", "radius").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("s"), F.count("re").alias("n"), F.count("*").alias("all"))
    return power.select("frequency", "radius", F.when(F.col("n") == F.col("all"), F.sqrt(F.col("s") * (0.5 / angles))).alias("voltage"))
