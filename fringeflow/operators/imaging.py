"""Array steps, one row an image: Fourier transforms, CLEAN, beam fit, restoring.

An image of one channel is an array in one row, whose size the image parameters
fix, so batches of rows are worked on where they are and nothing is shuffled.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STACK = 256
#: FWHM of a Gaussian in standard deviations.
FWHM = math.sqrt(8 * math.log(2))


class Beam(NamedTuple):
    """Full widths at half maximum in pixels, and the angle of the major axis in [0, pi), from axis 0 toward axis 1."""

    major: float
    minor: float
    theta: float

    @classmethod
    def of(cls, sigma1: float, sigma2: float, theta: float) -> Beam:
        """The beam of a Gaussian with standard deviation ``sigma1`` along ``theta`` and ``sigma2`` across it."""
        if sigma1 < sigma2:
            sigma1, sigma2, theta = sigma2, sigma1, theta + math.pi / 2
        return cls(sigma1 * FWHM, sigma2 * FWHM, theta % math.pi)


NO_BEAM = Beam(math.nan, math.nan, math.nan)


def grid_to_image(grid: np.ndarray) -> np.ndarray:
    """Unnormalised inverse transform, zero frequency and centre pixel at N / 2."""
    return np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(grid))) * grid.size


def image_to_grid(image: np.ndarray) -> np.ndarray:
    return np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(image)))


def clean(dirty: np.ndarray, psf: np.ndarray, gain: float = 0.1, minor: int = 1000, threshold: float = 0.0, border: int = 0, mode: str = "I") -> tuple[np.ndarray, np.ndarray, int]:
    """Model, residual and cycles of the minor loop on images (pols, H, W); ties go to the smallest y, then x."""
    residual, model = dirty.astype(float).copy(), np.zeros(dirty.shape)
    _, h, w = dirty.shape
    ph, pw = psf.shape[1:]
    for cycle in range(minor):
        metric = np.abs(residual[0]) if mode == "I" else (residual**2).sum(0)
        inner = metric[border : h - border, border : w - border]
        y, x = (int(i) + border for i in np.unravel_index(np.argmax(inner), inner.shape))
        if metric[y, x] < threshold or metric[y, x] == 0:
            return model, residual, cycle
        take = gain * residual[:, y, x]
        model[:, y, x] += take
        y0, x0 = y - ph // 2, x - pw // 2
        a, b, c, d = max(y0, 0), min(y0 + ph, h), max(x0, 0), min(x0 + pw, w)
        residual[:, a:b, c:d] -= take[:, None, None] * psf[:, a - y0 : b - y0, c - x0 : d - x0]
    return model, residual, minor


def clean_many(dirty: np.ndarray, psf: np.ndarray, gain: float = 0.1, minor: int = 1000, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Models and residuals of images (N, H, W) of one polarization, all a cycle at a time; each as ``clean`` gives it."""
    count, h, w = dirty.shape
    ph, pw = psf.shape
    top, left = ph // 2, pw // 2
    padded = np.zeros((count, h + ph, w + pw))  # an image's patch may hang over its edge
    padded[:, top : top + h, left : left + w] = dirty
    model, live = np.zeros(dirty.shape), np.arange(count)
    dy, dx = np.arange(ph)[None, :, None], np.arange(pw)[None, None, :]
    for _ in range(minor):
        inner = padded[live, top : top + h, left : left + w].reshape(len(live), -1)
        at = np.abs(inner).argmax(axis=1)
        peak = inner[np.arange(len(live)), at]
        go = (np.abs(peak) >= threshold) & (peak != 0)
        live, at, peak = live[go], at[go], gain * peak[go]
        if not len(live):
            break
        y, x = np.divmod(at, w)
        model[live, y, x] += peak
        padded[live[:, None, None], y[:, None, None] + dy, x[:, None, None] + dx] -= peak[:, None, None] * psf
    return model, padded[:, top : top + h, left : left + w]


def moments(psf: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Covariance (x, y) of the pixels above ``threshold`` about the centre, made larger by what a unit Gaussian loses where it is cut off at that height."""
    h, w = psf.shape
    y, x = np.nonzero(psf > threshold)
    v, y, x = psf[y, x], y - h // 2, x - w // 2
    lost = -math.log(threshold)  # half the squared radius of the cut
    return np.array([[(v * x * x).sum(), (v * x * y).sum()], [(v * x * y).sum(), (v * y * y).sum()]]) / v.sum() * (1 - threshold) / (1 - (1 + lost) * threshold)


def fit_beam(psf: np.ndarray, threshold: float = 0.01, rounds: int = 50) -> Beam:
    """The Gaussian with unit peak at the centre, by damped least squares.

    The fit is to the pixels above the threshold, from the moments of those above half the peak on. What is far from the centre is no Gaussian: hand over the central
    patch. All three are NaN where the pixels don't determine a Gaussian: none, too few, or a fit that doesn't fall off in all directions.
    """
    h, w = psf.shape
    y, x = np.mgrid[:h, :w]
    y, x, v = y - h // 2, x - w // 2, psf
    use = v > threshold
    y, x, v = y[use].astype(float), x[use].astype(float), v[use].astype(float)
    if not use.any() or np.linalg.matrix_rank(np.stack([x * x, x * y, y * y], 1)) < 3:
        return NO_BEAM
    start = moments(psf) if (psf > 0.5).any() else np.zeros((2, 2))
    inverse = np.linalg.inv(start) if np.linalg.det(start) > 1e-6 else np.eye(2) / 2
    p, damp = np.array([inverse[0, 0], inverse[0, 1], inverse[1, 1]]), 1e-3  # v = exp(-(a x^2 + 2 b x y + c y^2) / 2)
    model = lambda p: np.exp(np.minimum(-0.5 * (p[0] * x * x + 2 * p[1] * x * y + p[2] * y * y), 300.0))
    for _ in range(rounds):
        f = model(p)
        j = np.stack([-0.5 * x * x * f, -x * y * f, -0.5 * y * y * f], 1)
        step = np.linalg.lstsq(j.T @ j + damp * np.diag(np.diag(j.T @ j) + 1e-12), j.T @ (v - f), rcond=None)[0]
        if ((v - model(p + step)) ** 2).sum() <= ((v - f) ** 2).sum():
            p, damp = p + step, damp / 3
        else:
            damp *= 5
    values, axes = np.linalg.eigh(np.array([[p[0], p[1]], [p[1], p[2]]]))
    if values[0] <= 1e-12:
        return NO_BEAM
    return Beam.of(float(values[0] ** -0.5), float(values[1] ** -0.5), float(np.arctan2(axes[0, 0], axes[1, 0])))


def fit_image(image: np.ndarray) -> np.ndarray:
    """The beam of an image as one row, its centre pixel taken as the peak; NaN (null in the query) where that is 0 or not finite."""
    peak = image[image.shape[0] // 2, image.shape[1] // 2]
    return np.array([fit_beam(image / peak if peak and np.isfinite(peak) else np.zeros(image.shape))])


def convolve(model: np.ndarray, major: float, minor: float, angle: float) -> np.ndarray:
    """Restore a model with a Gaussian beam, by its transform (wraps around)."""
    h, w = model.shape
    fy, fx = np.meshgrid(np.fft.fftfreq(h), np.fft.fftfreq(w), indexing="ij")
    s1, s2 = major / FWHM, minor / FWHM
    a, b = fy * np.cos(angle) + fx * np.sin(angle), -fy * np.sin(angle) + fx * np.cos(angle)
    beam = 2 * np.pi * s1 * s2 * np.exp(-2 * np.pi**2 * ((a * s1) ** 2 + (b * s2) ** 2))
    return np.fft.ifft2(np.fft.fft2(model) * beam).real


def per_image(images: DataFrame, step) -> DataFrame:
    """Rows (img, y, x, value) of ``step``, which takes and gives stacks of images, applied to square images of (img, pixels); NaN becomes null. Null and empty images give none."""

    def run(batches):
        for batch in batches:
            pixels = batch.column(1)
            lengths = np.array([len(p) if p.is_valid else 0 for p in pixels], np.int64)
            img = batch.column(0).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths[lengths > 0]).tolist():
                rows, side = np.flatnonzero(lengths == size), math.isqrt(size)
                for k in range(0, len(rows), STACK):
                    some = rows[k : k + STACK]
                    stack = pixels.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), side, side)
                    out = step(stack)
                    n, y, x = np.indices(out.shape)
                    columns = img[some][n.ravel()], y.ravel(), x.ravel(), np.round(out.ravel(), 6)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind, from_pandas=True) for c, kind in zip(columns, [pa.int64()] * 3 + [pa.float64()])], ["img", "y", "x", "value"])

    # few files would leave cores idle: rows are dealt out, not grouped
    least = images.sparkSession.sparkContext.defaultParallelism
    dealt = images if images.rdd.getNumPartitions() >= least else images.repartition(least)
    return dealt.mapInArrow(run, "img long, y long, x long, value double")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("long").alias("img"), F.col("embedding").cast("array<double>").alias("pixels"))


_y, _x = np.mgrid[-4:5, -4:5]
PSF = np.exp(-(_y**2 + _x**2) / 2.0)[None]

def each(step):
    return lambda stack: np.stack([step(image) for image in stack])


QUERIES = {
    "clean_minor_loop": lambda s, d: per_image(_pixels(s, d), lambda i: clean_many(i, PSF[0])[0]),
    "clean_residual": lambda s, d: per_image(_pixels(s, d), lambda i: clean_many(i, PSF[0])[1]),
    "convolve_beam": lambda s, d: per_image(_pixels(s, d), each(lambda i: convolve(i, 3.0, 2.0, 0.5))),
    "fit_beam": lambda s, d: per_image(_pixels(s, d), each(fit_image)),
    "fft_image_to_grid": lambda s, d: per_image(_pixels(s, d), each(lambda i: np.abs(image_to_grid(i)))),
}
