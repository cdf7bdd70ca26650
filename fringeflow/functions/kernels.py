"""Kaiser-Bessel gridding kernels with w correction, and their taper."""

from __future__ import annotations

import numpy as np


def kaiser_bessel(x: np.ndarray, width: float, beta: float) -> np.ndarray:
    arg = 1 - (2 * np.asarray(x, float) / width) ** 2
    return np.where(arg >= 0, np.i0(beta * np.sqrt(np.maximum(arg, 0))) / np.i0(beta), 0.0)


def kaiser_bessel_fourier(f: np.ndarray, width: float, beta: float) -> np.ndarray:
    arg = (width * np.asarray(f, float)) ** 2 - (beta / np.pi) ** 2
    return width / np.i0(beta) * np.real(np.sinc(np.sqrt(arg.astype(complex))))


def beta_of(width: float) -> float:
    return 1.2 * np.pi * np.sqrt(0.25 * width**2 - 1)


def w_kernel(cell: float, w: float, width: int, oversample: int, taps: int, image_oversample: int) -> np.ndarray:
    """(oversample, taps) complex kernel at w; ``cell`` and w are in wavelengths."""
    n = taps * oversample * image_oversample
    step = 1 / (cell * taps * image_oversample)  # in l, as each output sample is cell / oversample apart
    l = (np.arange(n) - n // 2) * step  # noqa: E741
    shift = -0.5 * cell / oversample
    image = cell * kaiser_bessel_fourier(l * cell, width, beta_of(width)) * np.exp(2j * np.pi * (w * (0.5 * l**2 + 5 / 24 * l**4) + shift * l))
    samples = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(image))) * step
    crop = samples[(n - taps * oversample) // 2 :][: taps * oversample]
    return crop.reshape(taps, oversample)[:, ::-1].T


def taper(n: int, width: float, oversample: int) -> np.ndarray:
    x = np.arange(n) / n - 0.5
    return kaiser_bessel_fourier(x, width, beta_of(width)) * np.sinc(x / oversample)
