"""CLEAN with tiles and a PSF patch against the plain loop; thresholds; the primary beam."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.operators import cleaning, imaging, primary_beam
from fringeflow.operators.cleaning import CleanParameters, Tiles


def images(pols=4, size=75, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size] - size // 2
    psf = np.stack([np.exp(-(x**2 + y**2) / (2 + p)) + 0.02 * np.cos(0.7 * x + p) for p in range(pols)])
    psf /= psf[:, size // 2, size // 2][:, None, None]
    return rng.normal(size=(pols, size, size)) + 8 * (rng.random((pols, size, size)) > 0.999), psf


@pytest.mark.parametrize("mode", ["I", "SUMSQ"])
@pytest.mark.parametrize("border", [0.0, 0.1])
def test_tiles_equal_the_plain_loop(mode, border):
    dirty, psf = images()
    patch = cleaning.central(psf, cleaning.psf_patch(psf, 0.05, 0.5))
    edge = round(border * 75)
    model, left, cycles = imaging.clean(dirty, patch, minor=150, border=edge, mode=mode)
    tiles = Tiles(dirty.copy(), np.zeros(dirty.shape), patch, border, mode)
    done = sum(tiles.cycle(0.1) is not None for _ in range(150))
    assert done == cycles
    np.testing.assert_allclose(tiles.model, model, atol=1e-12)
    np.testing.assert_allclose(tiles.image, left, atol=1e-12)


def test_a_cycle_looks_only_at_tiles_under_the_patch(monkeypatch):
    dirty, psf = images(1, 320)
    tiles = Tiles(dirty, np.zeros(dirty.shape), cleaning.central(psf, (9, 9)), 0.0)
    seen = []
    monkeypatch.setattr(cleaning, "metric", lambda image, mode, plain=cleaning.metric: (seen.append(image.shape), plain(image, mode))[1])
    for _ in range(30):
        tiles.cycle(0.1)
    assert len(seen) <= 30 * 4 and all(s[1:] <= (32, 32) for s in seen)


def test_ties_and_thresholds_of_a_cycle():
    image = np.zeros((1, 64, 64))
    image[0, 5, 40] = image[0, 20, 3] = -2.0
    tiles = Tiles(image, np.zeros(image.shape), np.ones((1, 1, 1)), 0.0)
    assert tiles.cycle(1.0, 2.5) is None and tiles.cycle(1.0) == 2.0 and tiles.model[0, 5, 40] == -2.0
    assert tiles.cycle(1.0) == 2.0 and tiles.cycle(1.0) is None
    nan = np.full((1, 8, 8), np.nan)
    nan[0, 2, 2] = 1.0
    assert Tiles(nan, np.zeros(nan.shape), np.ones((1, 1, 1)), 0.0).cycle(0.5) == 1.0


def test_patch():
    psf = np.zeros((2, 16, 18))
    psf[:, 8, 9] = 1.0
    assert cleaning.psf_patch(psf, 0.01) == (1, 1) and cleaning.psf_patch(psf * 0, 0.01) == (1, 1)
    psf[1, 6, 12] = -0.5
    assert cleaning.psf_patch(psf, 0.01) == (5, 7) and cleaning.psf_patch(psf, 0.6) == (1, 1)
    psf[0, 0, 0] = 0.2
    assert cleaning.psf_patch(psf, 0.01) == (16, 18) and cleaning.psf_patch(psf, 0.01, 0.5) == (5, 7)
    assert cleaning.central(psf, (5, 7)).shape == (2, 5, 7) and cleaning.central(psf, (5, 7))[0, 2, 3] == 1.0


#: Chi-square points by tail probability and degrees of freedom.
POINTS = {(0.05, 1): 3.841458820694124, (0.05, 2): 5.991464547107979, (0.05, 3): 7.814727903251179, (0.05, 4): 9.487729036781154, (0.001, 4): 18.46682695290317, (0.5, 3): 2.3659738843753377}


def test_chi_square():
    for (p, k), x in POINTS.items():
        assert cleaning.chi_square_point(p, k) == pytest.approx(x, rel=1e-10)
    assert cleaning.noise_threshold_scale("I", 5.0, 4) == 5.0
    assert cleaning.noise_threshold_scale("SUMSQ", 3.0, 1) == pytest.approx(3.0)
    noise = np.random.default_rng(0).normal(size=(4, 400_000))
    over = (np.sqrt((noise**2).sum(axis=0)) > cleaning.noise_threshold_scale("SUMSQ", 2.0, 4)).mean()
    assert over == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=0.03)
    for mode in ("x", ""):
        with pytest.raises(ValueError):
            cleaning.noise_threshold_scale(mode, 1.0, 1)


def test_major_cycle_stops_at_the_larger_threshold():
    dirty, psf = images(1, 64, 3)
    dirty[0, 30, 30] = 100.0
    patch = cleaning.central(psf, (9, 9))
    for gain, want in ((0.5, 50.0), (1.0, None)):
        image, model = dirty.copy(), np.zeros(dirty.shape)
        got = cleaning.major_cycle(image, model, patch, CleanParameters(major_gain=gain, sigmas=6.0))
        assert not got["over"] and got["threshold"] == pytest.approx(want or 6.0 * cleaning.noise(dirty, 0.02))
        assert np.abs(image[0]).max() < got["threshold"] and np.abs(model).max() > 30
    quiet = cleaning.major_cycle(np.ones((1, 16, 16)), np.zeros((1, 16, 16)), np.ones((1, 1, 1)), CleanParameters())
    assert quiet["over"] and quiet["cycles"] == 1
    nothing = cleaning.major_cycle(np.zeros((1, 16, 16)), np.zeros((1, 16, 16)), np.ones((1, 1, 1)), CleanParameters())
    assert nothing["over"] and nothing["cycles"] == 0


def test_noise_of_all_polarizations():
    image = np.stack([np.full((10, 10), 1.0), np.full((10, 10), 3.0)])
    image[:, 0] = 99.0
    assert cleaning.noise(image, 0.1) == pytest.approx(2.0 * cleaning.MEDIAN_TO_RMS) and math.isnan(cleaning.noise(image, 0.5))


def test_peak_and_totals():
    image = np.array([[[1.0, -9.0], [np.nan, 4.0]]])
    assert cleaning.find_peak(image, np.array([[1.0, 0.1], [1.0, 1.0]]), 0.4) == 4.0 and math.isnan(cleaning.find_peak(image, np.ones((2, 2)), 5.0))
    assert cleaning.totals(image, 2.0, 3.0)[0] == pytest.approx(-4.0 / (2 * math.pi * 6 / (8 * math.log(2))))


def test_beam_fit_starts_from_moments_and_ignores_what_is_far():
    y, x = np.mgrid[-20:21, -20:21]
    a, b = x * math.cos(0.4) + y * math.sin(0.4), -x * math.sin(0.4) + y * math.cos(0.4)
    psf = np.exp(-(a**2 / 18 + b**2 / 8))
    cov = imaging.moments(psf)
    np.testing.assert_allclose(np.sort(np.linalg.eigvalsh(cov)), [4.0, 9.0], rtol=0.1)
    far = psf + 0.3 * np.exp(-((x - 15) ** 2 + (y + 15) ** 2) / 4)
    patch = cleaning.central(far[None], cleaning.psf_patch(psf[None], 0.01))[0]
    major, minor, angle = imaging.fit_beam(cleaning.central(far, (15, 15)))
    s = math.sqrt(8 * math.log(2))
    assert (major, minor) == pytest.approx((3 * s, 2 * s), rel=0.01) and angle == pytest.approx(math.pi / 2 - 0.4, abs=0.01)


def plain_beam(frequencies, curves, f, r, step):
    if not frequencies[0] <= f <= frequencies[-1]:
        return math.nan
    volts = [np.interp(f, frequencies, c) for c in np.array(curves).T]
    at = r / step
    return np.interp(at, range(len(volts)), volts) ** 2 if at < len(volts) - 1 else math.nan


def test_primary_beam(spark):
    frequencies, step = [1.0e9, 1.1e9, 1.5e9], 0.01
    curves = [[1.0, 0.8, 0.5, 0.1], [1.0, 0.7, 0.3, 0.0], [1.0, 0.4, 0.1, -0.2]]
    model = spark.createDataFrame([(f, r, v) for f, c in zip(frequencies, curves) for r, v in enumerate(c)], "frequency double, radius int, voltage double")
    wanted = [0.9e9, 1.0e9, 1.05e9, 1.1e9, 1.3e9, 1.5e9, 1.6e9]
    channels = spark.createDataFrame(list(enumerate(wanted)), "channel long, frequency double")
    got = primary_beam.radial(model, channels)
    assert got.count() == len(wanted)
    radii = spark.createDataFrame([(r,) for r in (0.0, 0.004, 0.01, 0.0299, 0.03, 0.05)], "r double")
    for row in got.crossJoin(radii).select("channel", "r", primary_beam.power(F.col("voltages"), F.col("r"), step).alias("p")).collect():
        assert row.p == pytest.approx(plain_beam(frequencies, curves, wanted[row.channel], row.r, step), nan_ok=True)
    volts = {r.channel: r.voltages for r in got.collect()}
    assert volts[0] is None and volts[6] is None and np.isnan(primary_beam.power_grid(None, step, 4, 1e-3)).all()
    grid = primary_beam.power_grid(volts[4], step, 8, 0.008)
    assert grid[4, 4] == 1.0 and grid[5, 6] == pytest.approx(plain_beam(frequencies, curves, 1.3e9, math.hypot(0.008, 0.016), step)) and np.isnan(grid[0, 0])
    out = primary_beam.correct(np.ones((8, 8)), grid, 0.2, -1.0)
    assert out[4, 4] == 1.0 and out[0, 0] == -1.0 and ((grid >= 0.2) == (out > 0)).all()
    for bad in ([(1e9, 0, 1.0), (1e9, 2, 1.0)], [(1e9, 0, 1.0), (2e9, 0, 1.0), (2e9, 1, 1.0)]):
        with pytest.raises(ValueError):
            primary_beam.radial(spark.createDataFrame(bad, model.schema), channels)
