"""Image, grid and w-kernel parameters (host side, per channel)."""

from __future__ import annotations

import bisect
import math

C = 299792458.0


def is_smooth(n: int) -> bool:
    """A multiple of 8 with no prime factor above 7: such numbers divide a power of 210."""
    return n > 0 and n % 8 == 0 and pow(210, n.bit_length(), n) == 0


def next_smooth(least: int) -> int:
    """The smallest smooth number of at least ``least``, among the products of powers of 3, 5 and 7 brought up by twos."""
    odd = [1]
    for p in (3, 5, 7):
        odd = [x * p**k for x in odd for k in range(int(math.log(8 * max(least, 1), p)) + 2)]
    return min(x << max(3, (-(-max(least, 1) // x) - 1).bit_length()) for x in odd)


def image_parameters(wavelength: float, diameter: float, longest: float, q_fov: float = 1.0, oversample: float = 5.0, pixel_size: float | None = None, pixels: int | None = None) -> dict:
    """pixel_size (sine of an angle), pixels, image_size and cell_size (metres)."""
    if pixel_size is None:
        if oversample < 3:
            raise ValueError("image_oversample must be at least 3")
        pixel_size = wavelength / (2 / 3 * oversample * longest)
    if pixels is None:
        cell = diameter * math.pi / (7.6634 * q_fov)
        pixels = next_smooth(int(0.98 * (wavelength / cell) / pixel_size))
    elif not is_smooth(pixels):
        raise ValueError(f"{pixels} pixels: not a multiple of 8 with small factors; the next is {next_smooth(pixels)}")
    size = pixel_size * pixels
    return {"pixel_size": pixel_size, "pixels": pixels, "image_size": size, "cell_size": wavelength / size}


def w_kernel_width(wl: float, fov: float, eps: float, antialias: float) -> float:
    """Cells that the w kernel needs at w (wavelengths)."""
    return math.sqrt(4 * fov**2 * ((wl * fov / 2) ** 2 + wl**1.5 * fov / (2 * math.pi * eps)) + antialias**2)


def w_slices(max_w: float, fov: float, eps: float, kernel_width: float, antialias: float) -> int:
    """The smallest number of slices whose half-thickness fits in the kernel."""
    fits = lambda s: w_kernel_width(max_w / 2 / (s - 0.5), fov, eps, antialias) <= kernel_width
    return 1 + bisect.bisect_left(range(1, 1 << 31), True, key=fits)


def check_grid(pixels: int, cell_size: float, longest: float, taps: int) -> None:
    """ValueError unless the longest baseline (metres), with its kernel, falls on the grid."""
    reach = longest / cell_size + taps / 2 + 1
    if reach > pixels / 2:
        raise ValueError(f"a baseline of {longest:g} m reaches {reach:.0f} cells from the centre of a grid of {pixels}: pixels are too large or too few")


def channel_parameters(
    frequency: float, diameter: float, longest: float, max_w: float, *, q_fov: float = 1.0, image_oversample: float = 5.0, pixel_size: float | None = None, pixels: int | None = None,
    slices: int | None = None, w_step: float = 1.0, w_step_unit: str = "", oversample: int = 8, taps: int = 60, antialias: float = 7.0, eps_w: float = 1e-3,
) -> dict:
    """wavelength, image and grid parameters of a channel: w slices from the kernel's taps unless given, and w planes of a slice from the w step, which is in metres
    (unit m) or in sub-cells (no unit). ValueError for other units and for grids that the longest baseline leaves."""
    if oversample < 1:
        raise ValueError("the grid's oversampling must be at least 1")
    wavelength = C / frequency
    image = image_parameters(wavelength, diameter, longest, q_fov, image_oversample, pixel_size, pixels)
    if slices is None:
        slices = w_slices(max_w / wavelength, image["image_size"], eps_w, taps, antialias)
    if w_step_unit not in ("", "m"):
        raise ValueError("the w step is a length or a number of sub-cells")
    step = w_step if w_step_unit == "m" else w_step * image["cell_size"] / oversample
    check_grid(image["pixels"], image["cell_size"], longest, taps)
    return {"wavelength": wavelength, **image, "w_slices": slices, "w_planes": max(1, math.ceil(max_w / step / slices))}
