import math

import numpy as np
import pytest

from fringeflow.functions import kernels, params
from fringeflow.functions.polarization import mueller, parse_stokes
from fringeflow.operators import imaging
from fringeflow.plans import relational
from fringeflow.sources.tables import TABLES


def test_mueller():
    want = 0.5 * np.array([[1, 0, 0, 1], [1, 0, 0, -1], [0, 1, 1, 0], [0, -1j, 1j, 0]])
    np.testing.assert_allclose(mueller(list("IQUV"), ["XX", "XY", "YX", "YY"]), want)
    with pytest.raises(ValueError):
        mueller(list("IQUV"), ["XX", "YY"])
    np.testing.assert_allclose(mueller(["I"], ["I", "XX", "YY"]), [[1 / 3, 1 / 3, 1 / 3]])


def test_parse_stokes():
    assert parse_stokes("QIV") == ["I", "Q", "V"]
    for bad in ("", "QQ", "Z"):
        with pytest.raises(ValueError):
            parse_stokes(bad)


def test_parameters():
    assert params.is_smooth(8 * 27 * 35) and not params.is_smooth(88) and not params.is_smooth(12)
    smooth = [n for n in range(1, 5000) if params.is_smooth(n)]
    assert smooth[:8] == [8, 16, 24, 32, 40, 48, 56, 64] and all(params.next_smooth(n) == min(x for x in smooth if x >= n) for n in range(0, 4800, 7))
    p = params.image_parameters(0.2, 13.5, 1000.0)
    assert params.is_smooth(p["pixels"]) and p["cell_size"] == pytest.approx(0.2 / p["image_size"])
    s = params.w_slices(5000.0, 0.02, 0.001, 20, 7)
    fits = lambda n: params.w_kernel_width(5000.0 / 2 / (n - 0.5), 0.02, 0.001, 7) <= 20
    assert fits(s) and (s == 1 or not fits(s - 1))


def test_kernel_is_symmetric_without_w():
    k = kernels.w_kernel(10.0, 0.0, 7, 8, 16, 4)
    assert k.shape == (8, 16)
    flat = k[::-1].T.ravel()
    np.testing.assert_allclose(flat.real, flat.real[::-1], atol=1e-9)
    assert abs(flat.real).argmax() in (63, 64)


def test_fft_round_trip():
    image = np.random.default_rng(1).normal(size=(16, 16))
    np.testing.assert_allclose(imaging.grid_to_image(imaging.image_to_grid(image)).real / image.size, image, atol=1e-9)


def test_clean_point_source():
    psf = imaging.PSF
    dirty = np.zeros((1, 32, 32))
    dirty[:, 12:21, 6:15] = 3 * psf
    model, residual, _ = imaging.clean(dirty, psf, minor=2000, threshold=1e-6)
    assert model[0, 16, 10] == pytest.approx(3, abs=1e-4) and abs(residual).max() < 1e-5


def test_clean_of_many_images():
    dirty = np.random.default_rng(4).normal(size=(5, 16, 16))
    dirty[3] = 0
    models, residuals = imaging.clean_many(dirty, imaging.PSF[0], minor=60, threshold=0.2)
    for d, m, r in zip(dirty, models, residuals):
        want = imaging.clean(d[None], imaging.PSF, minor=60, threshold=0.2)
        np.testing.assert_allclose(m, want[0][0])
        np.testing.assert_allclose(r, want[1][0])


def kernel_twin(cells, w_plane):
    """Taps of one sample by a plain double loop."""
    k = {tuple(map(int, r.split(", ")[:3])): complex(*map(int, r.split(", ")[3:])) for r in relational.kernel_rows()[1:-1].split("), (")}
    return {(u + a, v + b): k[w_plane, su, a] * k[w_plane, sv, b] for u, v, su, sv in cells for a in range(-3, 5) for b in range(-3, 5)}


@pytest.mark.parametrize("w", [0.0, 2.0])
def test_taps_are_centred_on_the_sample(w):
    """The taps at offsets -3 to 4 add up to the taper and the w phase of a sample in the middle of its sub-cell, whatever the sub-cell."""
    x, size = np.arange(64) / 64 - 0.5, 0.128
    k = kernels.w_kernel(1 / size, w, 7, 8, 8, 4)
    want = kernels.taper(64, 7, 8) * np.exp(2j * np.pi * w * (np.sqrt(1 - (x * size) ** 2) - 1))
    for s in range(8):
        at = np.arange(-3, 5) - (s + 0.5) / 8
        got = (np.conj(k[s])[:, None] * np.exp(2j * np.pi * x * at[:, None])).sum(0)
        assert np.abs(got - want)[12:52].max() < 2e-3


def test_kernel_gridding(spark, tmp_path):
    """One visibility spreads as its weight, density and the conjugate kernel say; degridding a model of one cell gives the kernel back."""
    one = [(1, 3, 2, 0, 27.0, 25300.0, 0.06, 0.01, "N")]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(one, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    for t in TABLES:
        if t != "lineitem":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    c = relational.QUERIES["uvw_fold_quantize"](spark, str(tmp_path)).first()
    taps = kernel_twin([(c.u, c.v, c.sub_u, c.sub_v)], c.w_plane)
    density = int(100 / (c.wt * 25.0 / c.wt + 1) + 0.5)
    got = {(r.u, r.v): complex(r.re, r.im) for r in relational.QUERIES["grid_kernel"](spark, str(tmp_path)).collect()}
    value = complex(c.re, c.im) * c.wt * density
    assert got == {at: value * k.conjugate() for at, k in taps.items()}
    r = relational.QUERIES["degrid_kernel"](spark, str(tmp_path)).first()
    left = complex(c.re, c.im) * c.wt * 10000 - c.wt * complex(c.re, c.im) * taps[c.u, c.v]
    assert complex(r.re, r.im) == left and r.weight == c.wt


def test_fit_and_restore():
    y, x = np.mgrid[-32:32, -32:32]
    major, minor, angle = imaging.fit_beam(np.exp(-(x**2 / 50 + y**2 / 8)))
    assert major == pytest.approx(5 * np.sqrt(8 * np.log(2)), rel=1e-3) and minor == pytest.approx(2 * np.sqrt(8 * np.log(2)), rel=1e-3)
    one = np.zeros((64, 64))
    one[32, 32] = 1
    np.testing.assert_allclose(imaging.convolve(one, major, minor, angle), np.exp(-(x**2 / 50 + y**2 / 8)), atol=1e-4)


def test_channel_parameters():
    p = params.channel_parameters(1.4e9, 13.5, 500.0, 400.0, slices=3)
    assert p["wavelength"] == pytest.approx(params.C / 1.4e9) and p["cell_size"] == pytest.approx(p["wavelength"] / (p["pixels"] * p["pixel_size"]))
    assert p["w_planes"] == math.ceil(400.0 / (p["cell_size"] / 8) / 3)
    assert params.channel_parameters(1.4e9, 13.5, 500.0, 400.0, slices=3, w_step=2.5, w_step_unit="m")["w_planes"] == math.ceil(160 / 3)
    assert params.channel_parameters(1.4e9, 13.5, 500.0, 400.0)["w_slices"] == params.w_slices(400.0 / p["wavelength"], p["image_size"], 1e-3, 60, 7.0)
    with pytest.raises(ValueError):
        params.channel_parameters(1.4e9, 13.5, 500.0, 400.0, w_step_unit="Hz")
    with pytest.raises(ValueError):  # the longest baseline leaves the grid
        params.channel_parameters(1.4e9, 13.5, 500.0, 400.0, pixel_size=1e-3, pixels=512)
    with pytest.raises(ValueError):
        params.channel_parameters(1.4e9, 13.5, 500.0, 400.0, oversample=0)
