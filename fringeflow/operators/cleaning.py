"""CLEAN of one channel's images: tile maxima, PSF patch, thresholds from noise and major gain, beam fit."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Of a Gaussian's absolute values: standard deviation / median.
MEDIAN_TO_RMS = 1.4826022185056031
TILE = 32


def metric(image: np.ndarray, mode: str) -> np.ndarray:
    """What a peak is the largest of, over images (pols, H, W): the absolute first polarization (I), or the sum of squares (SUMSQ). NaN counts as 0."""
    if mode not in ("I", "SUMSQ"):
        raise ValueError(f"no CLEAN mode {mode!r}")
    return np.nan_to_num(np.abs(image[0]) if mode == "I" else (image**2).sum(axis=0), nan=0.0, posinf=math.inf)


def metric_to_power(mode: str, value: float) -> float:
    return math.sqrt(value) if mode == "SUMSQ" else value


def power_to_metric(mode: str, power: float) -> float:
    return power * power if mode == "SUMSQ" else power


def chi_square_tail(x: float, freedom: int) -> float:
    """P(chi-square with ``freedom`` degrees > x), from 1 or 2 degrees up by twos."""
    half = x / 2
    a, tail = (0.5, math.erfc(math.sqrt(half))) if freedom % 2 else (1.0, math.exp(-half))
    while 2 * a < freedom:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1)) if half > 0 else 0.0
        a += 1
    return tail


def chi_square_point(p: float, freedom: int) -> float:
    """The x that a chi-square value passes with probability ``p``, by bisection to the last digit."""
    low, high = 0.0, 1.0
    while chi_square_tail(high, freedom) > p:
        low, high = high, 2 * high
    while low < (middle := (low + high) / 2) < high:
        low, high = (middle, high) if chi_square_tail(middle, freedom) > p else (low, middle)
    return high


def noise_threshold_scale(mode: str, sigmas: float, pols: int) -> float:
    """Times the noise at which CLEAN stops: ``sigmas``, or for sums of squares over ``pols`` polarizations the level that noise passes as seldom."""
    if mode == "I":
        return sigmas
    if mode != "SUMSQ":
        raise ValueError(f"no CLEAN mode {mode!r}")
    return math.sqrt(chi_square_point(math.erfc(sigmas / math.sqrt(2)), pols))


def inner(image: np.ndarray, border: float) -> np.ndarray:
    """``image`` (pols, H, W) without a border of ``border`` times its smaller side, rounded."""
    edge = round(border * min(image.shape[1:]))
    return image[:, edge : image.shape[1] - edge, edge : image.shape[2] - edge]


def noise(image: np.ndarray, border: float) -> float:
    """Standard deviation of noise by the median of absolute values over all polarizations; NaN where nothing is inside the border."""
    part = inner(image, border)
    return float(np.median(np.abs(part))) * MEDIAN_TO_RMS if part.size else math.nan


def psf_patch(psf: np.ndarray, threshold: float, limit: float | None = None) -> tuple[int, int]:
    """Height and width about the centre that hold all of ``psf`` (pols, H, W) of at least ``threshold``, at most ``limit`` times the smaller side: odd unless cut by
    the image, 1 x 1 where nothing is left."""
    _, h, w = psf.shape
    if limit is not None:
        reach = max((round(limit * min(h, w)) - 1) // 2, 0)
        psf = psf[:, max(0, h // 2 - reach) : h // 2 + reach + 1, max(0, w // 2 - reach) : w // 2 + reach + 1]
    _, y, x = np.nonzero(np.abs(psf) >= threshold)
    if not len(y):
        return 1, 1
    far = lambda at, size: min(size, 2 * int(np.abs(at - size // 2).max()) + 1)
    return far(y, psf.shape[1]), far(x, psf.shape[2])


def central(image: np.ndarray, patch: tuple[int, int]) -> np.ndarray:
    """The central window of the last two axes, the centre pixel (size // 2) at its centre."""
    (h, w), (a, b) = image.shape[-2:], patch
    y, x = h // 2 - a // 2, w // 2 - b // 2
    return image[..., y : y + a, x : x + b]


class Tiles:
    """Images (pols, H, W) under CLEAN: the largest metric of each tile inside the border is kept, and found anew only where a patch was subtracted."""

    def __init__(self, image: np.ndarray, model: np.ndarray, psf: np.ndarray, border: float, mode: str = "I", size: int = TILE):
        self.image, self.model, self.psf, self.mode, self.size = image, model, psf, mode, size
        self.edge = round(border * min(image.shape[1:]))
        _, h, w = image.shape
        self.rows, self.columns = (max(-(-(n - 2 * self.edge) // size), 0) for n in (h, w))
        self.most = np.zeros((self.rows, self.columns))
        self.at = np.zeros((self.rows, self.columns, 2), np.int64)
        self._renew(0, self.rows, 0, self.columns)

    def _renew(self, top: int, bottom: int, left: int, right: int) -> None:
        _, h, w = self.image.shape
        for i in range(top, bottom):
            y = self.edge + i * self.size
            for j in range(left, right):
                x = self.edge + j * self.size
                part = metric(self.image[:, y : min(y + self.size, h - self.edge), x : min(x + self.size, w - self.edge)], self.mode)
                k = int(part.argmax())
                self.most[i, j], self.at[i, j] = part.flat[k], (y + k // part.shape[1], x + k % part.shape[1])

    def cycle(self, gain: float, threshold: float = 0.0) -> float | None:
        """Subtract ``gain`` times the peak, a patch of the PSF, and add it to the model; the peak's metric before, None where it is below ``threshold`` or 0. The first
        of equal peaks by y, then x, is taken."""
        peak = self.most.max(initial=0.0)
        if peak < threshold or peak == 0:
            return None
        y, x = min(map(tuple, self.at[self.most == peak].tolist()))
        _, h, w = self.image.shape
        a, b = self.psf.shape[1:]
        y0, x0 = y - a // 2, x - b // 2
        top, bottom, left, right = max(y0, 0), min(y0 + a, h), max(x0, 0), min(x0 + b, w)
        take = gain * self.image[:, y, x]
        self.image[:, top:bottom, left:right] -= take[:, None, None] * self.psf[:, top - y0 : bottom - y0, left - x0 : right - x0]
        self.model[:, y, x] += take
        tile = lambda n, most: min(max(n, 0), most)
        s, e = self.size, self.edge
        self._renew(tile((top - e) // s, self.rows), tile(-(-(bottom - e) // s), self.rows), tile((left - e) // s, self.columns), tile(-(-(right - e) // s), self.columns))
        return float(peak)


@dataclass(frozen=True)
class CleanParameters:
    """Gain of a minor cycle and of a major one, cycles at most, sigmas to stop at, border, and the PSF's patch: least value, and share of the image at most."""

    minor_gain: float = 0.1
    major_gain: float = 0.85
    minor: int = 10000
    sigmas: float = 5.0
    border: float = 0.02
    mode: str = "I"
    patch_threshold: float = 0.01
    patch_limit: float = 0.5


def major_cycle(image: np.ndarray, model: np.ndarray, patch: np.ndarray, p: CleanParameters) -> dict:
    """Minor cycles on ``image`` and ``model`` in place, down to the larger of the noise's threshold and (1 - major gain) times the peak.

    The cycle that reads the peak already subtracts. Gives noise, threshold and cycles done, and whether the peak was at the threshold at once.
    """
    tiles = Tiles(image, model, patch, p.border, p.mode)
    level = noise(image, p.border)
    first = tiles.cycle(p.minor_gain)
    peak = metric_to_power(p.mode, first or 0.0)
    threshold = max(level * noise_threshold_scale(p.mode, p.sigmas, len(image)), (1 - p.major_gain) * peak)
    over, cycles = first is None or peak <= threshold, int(first is not None)
    if not over:
        least = power_to_metric(p.mode, threshold)
        while cycles < p.minor and tiles.cycle(p.minor_gain, least) is not None:
            cycles += 1
    return {"noise": level, "threshold": threshold, "cycles": cycles, "over": over}


def find_peak(image: np.ndarray, beam: np.ndarray, level: float) -> float:
    """Largest absolute value of images (pols, H, W) that stands out of the noise before the beam was divided out; NaN without any."""
    v = np.abs(image)
    with np.errstate(invalid="ignore"):
        v = v[v * beam > 7.5 * level]
    return float(v.max()) if v.size else math.nan


def totals(image: np.ndarray, major: float, minor: float) -> np.ndarray:
    """Sum of each polarization without NaN, over the area of the restoring beam (FWHM in pixels)."""
    return np.nansum(image, axis=(1, 2)) / (2 * math.pi * major * minor / (8 * math.log(2)))
