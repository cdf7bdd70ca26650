"""The chain from samples to restored images, and sky models."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.operators.cleaning import CleanParameters
from fringeflow.operators import polarize, spill
from fringeflow.plans import chain
from fringeflow.sources import products, sky

ONE = polarize.matrix(np.eye(1))
PIXELS, SIZE, MAX_W = 64, 2e-3, 9.0
WAVELENGTHS = {0: 1.0, 1: 1.1}
SOURCES = [(9 * SIZE, -6 * SIZE, 2.0), (-12 * SIZE, 10 * SIZE, 1.0)]
SAMPLES = "row_id long, channel long, u double, v double, w double, re array<double>, im array<double>, weight array<double>"


def simulate(uvw, sources, wavelength):
    """Direct sums of point sources (l, m, flux), flux an array of polarizations."""
    out = 0
    for l, m, flux in sources:  # noqa: E741
        phase = uvw @ np.array([l, m, math.sqrt(1 - l * l - m * m) - 1]) / wavelength
        out = out + np.exp(-2j * np.pi * phase)[:, None] * np.atleast_1d(flux)
    return out


def uvw_of(n=900):
    rng = np.random.default_rng(3)
    # a sample that would leave the grid raises: none does
    return np.column_stack([np.clip(rng.normal(0, 70, (n, 2)), -180, 180), rng.uniform(-8, 8, n)])


def frame(spark, sources=SOURCES, uvw=None):
    uvw = uvw_of() if uvw is None else uvw
    rows = []
    for c, wl in WAVELENGTHS.items():
        vis = simulate(uvw, sources, wl)
        rows += [(i, c, *map(float, uvw[i]), vis[i].real.tolist(), vis[i].imag.tolist(), [1.0] * vis.shape[1]) for i in range(len(uvw))]
    return spark.createDataFrame(rows, SAMPLES)


def params_of(spark, channels=WAVELENGTHS):
    return chain.parameters(spark, [{"channel": c, "wavelength": wl, "pixels": PIXELS, "pixel_size": SIZE, "cell_size": wl / (PIXELS * SIZE), "w_slices": 2, "w_planes": 4} for c, wl in channels.items()], MAX_W)


@pytest.fixture(scope="module")
def simulated(spark):
    return frame(spark), params_of(spark)


def test_grid_and_fft_equal_a_direct_sum(spark, simulated):
    samples, params = simulated
    records = spill.with_band(chain.weigh(chain.preprocess(samples, params, ONE)))
    got = {r.channel: np.reshape(r.image, (64, 64)) for r in chain.to_images(chain.grid(records, chain.kernels(params)), params).collect()}
    uvw, vis = uvw_of(), simulate(uvw_of(), SOURCES, 1.0)
    l = (np.arange(64) - 32) * SIZE  # noqa: E741
    n = np.sqrt(1 - l[:, None] ** 2 - l**2)
    want = sum((v * np.exp(2j * np.pi * (r[0] * l + r[1] * l[:, None] + r[2] * (n - 1)))).real for r, v in zip(uvw, vis[:, 0])) * n
    inner = slice(12, 52)
    assert np.abs(got[0] - want)[inner, inner].max() < 0.02 * np.abs(want).max()


def test_sources_are_restored_where_they_are(spark, simulated):
    got = chain.image_channels(*simulated, ONE, "robust", majors=3, clean=CleanParameters(minor=400, sigmas=3.0)).collect()
    assert {r.channel for r in got} == {0, 1}
    for r in got:
        image, model = (np.reshape(x, (64, 64)) for x in (r.restored, r.model))
        assert np.unravel_index(image.argmax(), image.shape) == (26, 41)
        assert image[26, 41] == pytest.approx(2.0, abs=0.1) and image[42, 20] == pytest.approx(1.0, abs=0.1)
        assert model.sum() == pytest.approx(3.0, abs=0.3) and r.peak == pytest.approx(2.0, abs=0.1)
        assert r.weights_noise > 0 and r.normalized_noise >= 1 and r.compressed_vis > 0 and r.majors >= 1


def test_records_in_memory_give_the_same(spark, simulated):
    options = {"majors": 1, "clean": CleanParameters(minor=20)}
    images = lambda **more: {(r.channel, r.pol): r.restored for r in chain.image_channels(*simulated, ONE, **options, **more).collect()}
    one, other = images(), images(store=spill.MemoryStore)
    assert set(one) == set(other)
    for k in one:
        np.testing.assert_allclose(one[k], other[k], atol=1e-9)


def test_samples_are_not_dealt_by_channel(spark, simulated):
    """Samples meet their channel's parameters where they are read, and cells the channel's mean; only the mean itself is summed by channel."""
    samples, params = simulated
    with spill.in_place(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        records = chain.preprocess(samples, params, ONE)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (records, chain.weigh(records, "robust"))]
    keys = [[re.findall(r"([a-z_]+)#", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)] for plan in plans]
    assert [k.count(["channel"]) for k in keys] == [0, 1] and any("sub_u" in k for k in keys[0])


def test_a_later_cycle_leaves_the_records_where_they_are(spark, simulated, tmp_path):
    samples, params = simulated
    name = spill.write(chain.weigh(chain.preprocess(samples, params, ONE)), str(tmp_path), 4)
    stored, k = spill.read(spark, name), chain.kernels(params)
    models = spark.createDataFrame([(0, 0, [1.0] * PIXELS**2), (1, 0, [0.0] * PIXELS**2)], "channel long, pol long, model array<double>")
    slices = spark.createDataFrame([(c, s) for c in (0, 1) for s in (0, 1)], "channel long, w_slice long")
    with spill.in_place(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        left = chain.residual(stored, chain.to_grid(models, slices, params), k)
        plan = left._jdf.queryExecution().executedPlan().toString()
        # the model's images meet slices and parameters by channel, and its cells are dealt to parts; records are joined and summed where they lie
        moved = [line.split("hashpartitioning(")[1].split(", ENSURE")[0] for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        keys = [re.findall(r"([a-z_]+)#", m) for m in moved]
        assert sorted(keys) == [["channel"]] * 3 + [["channel", "w_slice", "band"]]
        assert f"spark_catalog.default.{name}" in plan
        assert left.count() == stored.count()
    spill.drop(spark, name)


def test_residual_is_what_a_model_leaves(spark, simulated):
    """A point at the centre predicts its flux, its phase 0, at every record."""
    samples, params = simulated
    records = spill.with_band(chain.weigh(chain.preprocess(samples, params, ONE)))
    image = np.zeros((PIXELS, PIXELS))
    image[32, 32] = 0.5
    models = spark.createDataFrame([(0, 0, image.ravel().tolist())], "channel long, pol long, model array<double>")
    slices = spark.createDataFrame([(0, 0), (0, 1)], "channel long, w_slice long")
    left = chain.residual(records, chain.to_grid(models, slices, params), chain.kernels(params)).toPandas()
    key = ["channel", "pol", "w_slice", "w_plane", "u", "v", "sub_u", "sub_v"]
    both = left.merge(records.toPandas(), on=key, suffixes=("", "0"))
    assert len(both) == len(left)
    first = both[both.channel == 0]
    np.testing.assert_allclose(first.re0 - first.re, 0.5 * first.weight, rtol=0.02)
    np.testing.assert_allclose(first.im0 - first.im, 0, atol=0.01)
    other = both[both.channel == 1]
    assert (other.re == other.re0).all() and (other.im == other.im0).all()


def test_off_the_grid_raises_and_beyond_max_w_is_held(spark):
    params = params_of(spark)
    far = frame(spark, uvw=np.array([[400.0, 0, 0]]))
    with pytest.raises(Exception, match="off the grid"):
        chain.preprocess(far, params, ONE).collect()
    deep = chain.preprocess(frame(spark, uvw=np.array([[1.0, 2.0, 99.0]])), params, ONE).collect()
    assert len(deep) == 2 and all((r.w_slice, r.w_plane) == (1, 3) for r in deep)


def test_channels_without_data_have_no_row(spark, simulated):
    samples, params = simulated
    assert chain.image_channels(samples.where("false"), params, ONE, majors=1).count() == 0
    # channel 1's weights cancel nothing but its density does: no peak
    none = samples.withColumn("weight", F.when(F.col("channel") == 1, F.array(F.lit(0.0))).otherwise(F.col("weight")))
    assert {r.channel for r in chain.image_channels(none, params, ONE, majors=1, clean=CleanParameters(minor=3)).select("channel").collect()} == {0}


def test_a_psf_without_a_peak_is_skipped(spark):
    params = params_of(spark)
    flat = [(c, p, [float(c)] * PIXELS**2) for c in (0, 1) for p in (0, 1)]
    got = chain.point_spread(spark.createDataFrame(flat, "channel long, pol long, image array<double>"), params, CleanParameters()).collect()
    assert [r.channel for r in got] == [1]


def test_a_sky_model_is_subtracted_first(spark):
    """Sources of the catalogue vanish from the records; what it lacks is imaged."""
    ra0, dec0 = 1.0, -0.5
    lines = []
    for l, m, flux in SOURCES:  # noqa: E741
        n = math.sqrt(1 - l * l - m * m)
        dec = math.asin(m * math.cos(dec0) + n * math.sin(dec0))
        ra = ra0 + math.atan2(l, n * math.cos(dec0) - m * math.sin(dec0))
        lines.append((ra, dec, 1e6, 1e9, [math.log10(flux), 0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]))
    catalogue = spark.createDataFrame(lines, "ra double, dec double, min_hz double, max_hz double, coefficients array<double>, stokes array<double>")
    params = params_of(spark)
    samples = frame(spark, SOURCES)
    records = chain.preprocess(samples, params, ONE)
    left = chain.subtract_sky(records, catalogue, params, (ra0, dec0)).toPandas()
    assert len(left) == records.count() and np.abs(left.re + 1j * left.im).median() < 0.1  # of 3: a sub-cell is half a wavelength wide
    got = chain.image_channels(samples, params, ONE, majors=1, clean=CleanParameters(minor=50), sky=catalogue.limit(1), centre=(ra0, dec0)).where("channel = 0").first()
    image = np.reshape(got.restored, (64, 64))
    at = tuple(int(i) for i in np.unravel_index(image.argmax(), image.shape))
    assert at in {(26, 41), (42, 20)} and image[{(26, 41): (42, 20), (42, 20): (26, 41)}[at]] < 0.2


def test_a_primary_beam_is_divided_out(spark, simulated):
    samples, params = simulated
    step = 0.01
    volts = [1.0, 0.9, 0.7, 0.5, 0.2]
    beam = spark.createDataFrame([(c, volts) for c in (0, 1)], "channel long, voltages array<double>")
    plain = chain.image_channels(samples, params, ONE, majors=1, clean=CleanParameters(minor=100)).where("channel = 0").first()
    got = chain.image_channels(samples, params, ONE, majors=1, clean=CleanParameters(minor=100), beam=beam, beam_step=step, cutoff=0.3).where("channel = 0").first()
    power = np.reshape(got.primary_beam, (64, 64))
    r = math.hypot(9, 6) * SIZE / step
    assert power[26, 41] == pytest.approx((0.7 + (0.9 - 0.7) * (2 - r) if r < 2 else 0.7 + (0.5 - 0.7) * (r - 2)) ** 2)
    model, before = np.reshape(got.model, (64, 64)), np.reshape(plain.model, (64, 64))
    inside = power >= 0.3
    np.testing.assert_allclose(model[inside], before[inside] / power[inside])
    assert (model[~inside] == 0).all() and np.isnan(np.reshape(got.residual, (64, 64))[~inside]).all() and np.isnan(power[0, 0])


def test_weights_of_unknown_kind(spark, simulated):
    with pytest.raises(ValueError):
        chain.weigh(chain.preprocess(*simulated, ONE), "briggs")


LINES = ["# a comment", "", "near|alias, radec, 1:00:00, -30:30:00, (500 2000 1.0 -0.5 0 0 0 0 1 0.1)", "plain, radec bfcal, 15.0, 2.0", "sat, tle, x, y", "*star, radec, 0:00:00, -0:30:00, (900 1000 0.3)"]


def test_catalogue(spark):
    d = sky.parse_catalogue(spark.createDataFrame([(x,) for x in LINES], "value string"))
    got = {r.name: r for r in d.collect()}
    assert set(got) == {"near", "plain", "star"}
    assert got["near"].ra == pytest.approx(math.radians(15)) and got["near"].dec == pytest.approx(math.radians(-30.5))
    assert got["star"].dec == pytest.approx(math.radians(-0.5)) and got["plain"].ra == pytest.approx(math.radians(15))
    flux = {r["name"]: r["f"] for r in d.select("name", sky.flux_density(F.lit(1e9)).alias("f")).collect()}
    assert flux["near"] == pytest.approx([10 ** (1 - 1.5), 0.1 * 10 ** (1 - 1.5), 0, 0]) and flux["plain"] == [0, 0, 0, 0] and flux["star"][0] == pytest.approx(10**0.3)
    row = d.where("name = 'near'").select(*sky.direction_cosines(got["near"].ra, got["near"].dec - 0.01)).first()
    assert row[0] == pytest.approx(0) and row[1] == pytest.approx(math.sin(0.01)) and row[2] == pytest.approx(math.cos(0.01) - 1)


def test_sky_model_addresses(spark, tmp_path):
    (tmp_path / "c.csv").write_text("\n".join(LINES))
    for url in (f"file://{tmp_path}/c.csv?format=katpoint", f"{tmp_path}/c.csv", f"file://{tmp_path}/c.csv"):
        assert sky.open_sky_model(spark, url).count() == 3
    streams = [("a", "sdp.continuum_image", "t", LINES[2]), ("b", "sdp.spectral_image", "t", LINES[3]), ("a", "sdp.continuum_image", "other", LINES[3]), ("c", "continuum_image", "t", LINES[5])]
    d = spark.createDataFrame(streams, "stream string, kind string, target string, line string")
    one = d.where("stream <> 'c'")
    one.write.parquet(f"{tmp_path}/x.rdb/streams")
    d.write.parquet(f"{tmp_path}/y.rdb/streams")
    names = lambda url: [r.name for r in sky.open_sky_model(spark, url).collect()]
    assert names(f"{tmp_path}/x.rdb?format=archive&target=t") == ["near"] and names(f"file://{tmp_path}/y.rdb?format=archive&target=t&continuum=c") == ["star"]
    for url in (f"http://x/c.csv?format=katpoint", f"{tmp_path}/c.csv?format=x", f"{tmp_path}/x.rdb?format=archive"):
        with pytest.raises(ValueError):
            sky.open_sky_model(spark, url)
    for bad, target in ((d.where("stream = 'b'"), "t"), (d, "t"), (one, "nowhere")):
        with pytest.raises(sky.NoSkyModel):
            sky.stream_catalogue(bad, target)


def headers(data):
    """Cards of a FITS file, and its big-endian pixels."""
    cards, at = {}, 0
    while True:
        card = data[at : at + 80].decode("ascii")
        at += 80
        if card.startswith("END"):
            break
        value = card[10:].strip()
        cards[card[:8].strip()] = value.strip("' ") if value.startswith("'") else value == "T" if value in "TF" else float(value) if "." in value or "E" in value else int(value)
    start = -(-at // 2880) * 2880
    shape = [cards[f"NAXIS{i}"] for i in range(cards["NAXIS"], 0, -1)]
    assert len(data) % 2880 == 0
    return cards, np.frombuffer(data, ">f4", int(np.prod(shape)), start).reshape(shape)


def test_run_writes_each_channel_once(spark, simulated, tmp_path):
    """Products as tables, by status: what is done is left, what has no data is told, what is masked has no status."""
    samples, params = simulated
    more = params.union(chain.parameters(spark, [{"channel": c, "wavelength": 1.2, "pixels": PIXELS, "pixel_size": SIZE, "cell_size": 1.2 / (PIXELS * SIZE), "w_slices": 2, "w_planes": 4} for c in (7, 8)], MAX_W))
    writer = products.TableWriter(str(tmp_path / "out"), ("clean", "psf", "dirty", "weights", "grid", "model"))
    enabled = spark.createDataFrame([(0, True), (1, False), (7, True), (8, False)], "channel long, enabled boolean")
    options = {"majors": 1, "clean": CleanParameters(minor=5)}
    chain.run(samples, more, ONE, writer, enabled, batch=1, **options)
    assert sorted(map(tuple, writer.done(spark).collect())) == [(0, "complete"), (7, "no-data")]
    assert sorted(r.channel for r in products.remaining(more, writer).collect()) == [1, 8]
    chain.run(samples, more.where("channel < 8"), ONE, writer, **options)
    got = spark.read.parquet(f"{tmp_path}/out/images").collect()
    assert sorted((r.channel, r["product"], len(r.pixels)) for r in got) == sorted((c, p, PIXELS**2 * (2 if p == "grid" else 1)) for c in (0, 1) for p in writer.products)
    image = {(r.channel, r["product"]): np.reshape(r.pixels, (PIXELS, PIXELS)) for r in got if r["product"] != "grid"}
    assert image[0, "psf"][32, 32] == pytest.approx(1) and image[0, "dirty"][26, 41] == pytest.approx(2, rel=0.1)
    assert set(np.unique(image[0, "weights"])) == {0.0, 1.0}
    stats = {r.channel: r for r in spark.read.parquet(f"{tmp_path}/out/statistics").collect()}
    assert set(stats) == {0, 1} and stats[0].cycles == 5 and stats[0].compressed_vis > 0
    with pytest.raises(ValueError):
        products.TableWriter(str(tmp_path), ("thumbnail",))


def test_fits_files(spark, simulated, tmp_path):
    samples, params = simulated
    writer = products.FitsFileWriter(str(tmp_path / "files"), ("clean", "grid", "weights"), ("I",), ra="1.0", dec="-0.5", headers=json.dumps({"OBSERVER": "someone"}))
    chain.run(samples, params, ONE, writer, majors=1, clean=CleanParameters(minor=50))
    names = sorted(p.name for p in (tmp_path / "files").glob("*.fits"))
    assert names == sorted(f"{p}-{c:05d}.fits" for p in writer.products for c in (0, 1)) and not list((tmp_path / "files").glob(".writing*"))
    head, data = headers((tmp_path / "files/clean-00001.fits").read_bytes())
    assert data.shape == (1, 1, PIXELS, PIXELS) and np.unravel_index(data.argmax(), data.shape)[2:] == (26, PIXELS - 1 - 41)
    step = math.degrees(math.asin(SIZE))
    assert (head["CTYPE1"], head["CRPIX1"], head["CDELT1"], head["CRPIX2"], head["CTYPE3"], head["CRVAL3"]) == ("RA---SIN", 32.0, pytest.approx(-step), 33.0, "STOKES", 1.0)
    assert head["CRVAL1"] == pytest.approx(math.degrees(1)) and head["CRVAL4"] == pytest.approx(299792458 / 1.1) and head["OBSERVER"] == "someone"
    assert head["DATAMAX"] == pytest.approx(data.max()) and 0 < head["BMIN"] <= head["BMAJ"] and "BMAJ" not in headers((tmp_path / "files/weights-00000.fits").read_bytes())[0]
    head, data = headers((tmp_path / "files/grid-00000.fits").read_bytes())
    assert data.shape == (2, 1, PIXELS, PIXELS) and head["CTYPE4"] == "COMPLEX" and head["CDELT1"] == pytest.approx(1 / (PIXELS * SIZE))


def test_fits_folders_and_failed_jobs(spark, tmp_path):
    from fringeflow.sources import fits

    rng = np.random.default_rng(1)
    images = {p: rng.normal(size=(8, 8)) for p in range(4)}
    images[0][0, 0] = math.nan
    rows = [(5, "clean", p, images[p].ravel().tolist(), 0.2, 1e-3, 25.0, 2.0, 1.5, 0.3) for p in (2, 0, 3, 1)]
    fits.write(spark.createDataFrame(rows, fits.SCHEMA), str(tmp_path / "a"), polarizations="XX,XY,YX,YY", prefix="cube", metadata=json.dumps({"Project": "x"}))
    (folder,) = (tmp_path / "a").iterdir()
    assert sorted(p.name for p in folder.iterdir()) == ["cube_00005.fits", "cube_00005.fits.tnail.png", "metadata.json"]
    head, data = headers((folder / "cube_00005.fits").read_bytes())
    # YY, XX, YX, XY: -5 to -8
    assert (head["CRVAL3"], head["CDELT3"]) == (-5.0, -1.0)
    np.testing.assert_allclose(data[0, :, :, ::-1], np.stack([images[p] for p in (3, 0, 2, 1)]).astype("f4"))
    about = json.loads((folder / "metadata.json").read_text())
    assert about["Project"] == "x" and about["Run"] == 5 and about["CenterFrequency"] == pytest.approx(299792458 / 0.2)
    assert (folder / "cube_00005.fits.tnail.png").read_bytes()[:4] == b"\x89PNG"
    with pytest.raises(Exception, match="polarizations"):  # one is missing, of the second channel
        fits.write(spark.createDataFrame(rows + [(6, *r[1:]) for r in rows[:3]], fits.SCHEMA), str(tmp_path / "b"), polarizations="XX,XY,YX,YY")
    assert not (tmp_path / "b").exists() or not list((tmp_path / "b").iterdir())
    with pytest.raises(ValueError):
        fits.polarization_axis(["I", "Q", "V"], 3)
    small, scale = fits.downsample(np.arange(64.0).reshape(8, 8), 2)
    assert scale == 4 and small.tolist() == [[13.5, 17.5], [45.5, 49.5]]
