"""Samples to compressed records: fold, weight, quantise, pre-aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["channel", "u", "v", "sub_u", "sub_v", "w_plane", "w_slice"]


def quantize(samples: DataFrame, oversample: int) -> DataFrame:
    """Fold to w >= 0, multiply by the weight, and put uvw on the grid: rows (channel, pol, u, v, w, weight, re, im) with their channel's cell_size, w_slices,
    w_planes and max_w, lengths in one unit. What is beyond max_w is held in the last w plane."""
    d = samples
    sign = F.when(F.col("w") < 0, -1.0).otherwise(1.0)
    fine = lambda c: F.floor(F.col(c) * sign / F.col("cell_size") * oversample)
    planes, slices = F.col("w_planes"), F.col("w_slices")
    plane = F.least(F.floor(F.abs("w") * (slices - 0.5) * planes / F.col("max_w") + planes / 2), slices * planes - 1)
    d = d.select("channel", "pol", fine("u").alias("fu"), fine("v").alias("fv"), plane.alias("p"), planes.alias("planes"), "weight", (F.col("re") * F.col("weight")).alias("re"), (F.col("im") * F.col("weight") * sign).alias("im"))
    return d.select(
        "channel", "pol", F.floor(F.col("fu") / oversample).alias("u"), F.floor(F.col("fv") / oversample).alias("v"), F.pmod("fu", F.lit(oversample)).alias("sub_u"),
        F.pmod("fv", F.lit(oversample)).alias("sub_v"), (F.col("p") % F.col("planes")).alias("w_plane"), F.floor(F.col("p") / F.col("planes")).alias("w_slice"), "weight", "re", "im",
    )


def compress(quantized: DataFrame) -> DataFrame:
    """Sums of weight and weighted value per sub-cell, before taps multiply the rows."""
    return quantized.groupBy(*KEY, "pol").agg(F.sum("weight").alias("weight"), F.sum("re").alias("re"), F.sum("im").alias("im"))
