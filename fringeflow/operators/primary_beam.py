"""Primary beam: voltages by frequency and radius, interpolated in both, squared to power."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def radial(beam: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel, voltages): the voltages along the radius at each channel's frequency, between the two frequencies of ``beam`` around it.

    ``beam`` has (frequency, radius, voltage), ``radius`` counting steps from 0 on; ``channels`` has (channel, frequency). A frequency outside the model's has
    null voltages. ValueError where frequencies have different numbers of radii or a radius is missing. The model is small, as many rows as were measured.
    """
    curves = beam.groupBy("frequency").agg(F.transform(F.array_sort(F.collect_list(F.struct("radius", "voltage"))), lambda x: x["voltage"]).alias("v"), F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    odd = curves.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.when((F.col("low") != 0) | (F.col("high") != F.col("n") - 1), 1).otherwise(0)).alias("gap")).first()
    if odd["least"] != odd["most"] or odd["gap"]:
        raise ValueError("frequencies of the beam have different or missing radii")
    order = Window.orderBy("frequency")  # a row a frequency of the model
    pairs = curves.select("frequency", "v", F.coalesce(F.lead("frequency").over(order), "frequency").alias("next"), F.coalesce(F.lead("v").over(order), "v").alias("w"), F.row_number().over(order).alias("k"))
    f = F.col("f")
    met = channels.select("channel", F.col("frequency").cast("double").alias("f")).join(F.broadcast(pairs), (f >= F.col("frequency")) & (f <= F.col("next")), "left")
    share = F.when(F.col("next") > F.col("frequency"), (f - F.col("frequency")) / (F.col("next") - F.col("frequency"))).otherwise(0.0)
    between = met.withColumn("t", share).select("channel", "k", F.zip_with("v", "w", lambda a, b: a + (b - a) * F.col("t")).alias("voltages"))
    return between.groupBy("channel").agg(F.min_by("voltages", "k").alias("voltages"))  # a frequency of the model itself meets two pairs, with one result


def power(voltages: Column, radius: Column, step: float) -> Column:
    """Power at a radius (sine of an angle): voltages interpolated between steps, squared; NaN from the last step on and where there are none."""
    at = radius / step
    low = F.floor(at)
    a, b = (F.try_element_at(voltages, (low + k).cast("int")) for k in (1, 2))
    volt = a + (b - a) * (at - low)
    return F.coalesce(volt * volt, F.lit(float("nan")))


def power_grid(voltages: np.ndarray | None, step: float, pixels: int, pixel_size: float) -> np.ndarray:
    """Power at each pixel of a square image, as ``power`` gives it."""
    if voltages is None:
        return np.full((pixels, pixels), np.nan)
    c = (np.arange(pixels) - pixels // 2) * pixel_size
    at = np.hypot(c[:, None], c) / step
    low = at.astype(int)
    v = np.append(np.asarray(voltages, float), [np.nan] * 2)
    low_in = np.minimum(low, len(v) - 2)
    volt = v[low_in] + (v[low_in + 1] - v[low_in]) * (at - low)
    return volt * volt


def correct(image: np.ndarray, beam: np.ndarray, cutoff: float, outside: float) -> np.ndarray:
    """``image`` divided by the beam's power; ``outside`` where that is below ``cutoff`` or not known."""
    good = beam >= cutoff
    return np.where(good, image / np.where(good, beam, 1.0), outside)
