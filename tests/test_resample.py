"""Resampling and uv coverage against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.operators import coverage, feed, resample
from fringeflow.operators.resample import World


def pixels(spark, images):
    rows = [(i, y, x, float(v)) for i, image in images.items() for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "img long, y long, x long, value double")


def plain_value(image, y, x):
    if math.isnan(y) or math.isnan(x):
        return None
    y0, x0 = math.floor(y), math.floor(x)
    total = 0.0
    for dy in (0, 1):
        for dx in (0, 1):
            share = (y - y0 if dy else 1 - (y - y0)) * (x - x0 if dx else 1 - (x - x0))
            if share > 0:
                if not (0 <= y0 + dy < image.shape[0] and 0 <= x0 + dx < image.shape[1]) or math.isnan(image[y0 + dy, x0 + dx]):
                    return None
                total += share * image[y0 + dy, x0 + dx]
    return total


@pytest.mark.parametrize("tile", [3, 256])
def test_bilinear(spark, tile):
    rng = np.random.default_rng(8)
    images = {0: rng.normal(size=(7, 9)), 1: rng.normal(size=(5, 5))}
    images[1][2, 2] = np.nan
    points = [(int(i), float(y), float(x), k) for k, (i, y, x) in enumerate(zip(rng.integers(0, 2, 200), rng.uniform(-1, 7, 200), rng.uniform(-1, 9, 200)))]
    points += [(0, 6.0, 8.0, 900), (0, 0.0, 0.0, 901), (0, 6.0, 7.5, 902), (0, math.nan, 1.0, 903), (1, 1.0, 1.0, 904), (7, 1.0, 1.0, 905)]
    got = resample.bilinear(spark.createDataFrame(points, "img long, y double, x double, k long"), pixels(spark, images), ["img"], ["value"], tile)
    found = {r.k: r.value for r in got.collect()}
    assert set(found) == {p[3] for p in points}
    for i, y, x, k in points:
        want = plain_value(images[i], y, x) if i in images else None
        assert found[k] == (pytest.approx(want) if want is not None else None)


def test_worlds_there_and_back(spark):
    a = World(16, 15, 1e-3, -1e-3, 1.0, -0.7)
    d = spark.createDataFrame([(float(y), float(x)) for y in range(0, 32, 5) for x in range(0, 32, 5)], "y double, x double")
    ra, dec = a.to_world(F.col("y"), F.col("x"))
    y, x = a.to_pixel(F.col("ra"), F.col("dec"))
    for r in d.withColumns({"ra": ra, "dec": dec}).select("*", y.alias("y2"), x.alias("x2")).collect():
        assert (r.y2, r.x2) == (pytest.approx(r.y, abs=1e-8), pytest.approx(r.x, abs=1e-8))
    far = World(0, 0, 1.0, 1.0, 0.0, 0.0)
    assert math.isnan(d.select(far.to_world(F.lit(1.0), F.lit(1.0))[0].alias("v")).first().v)
    assert math.isnan(d.select(far.to_pixel(F.lit(math.pi), F.lit(0.0))[0].alias("v")).first().v)


def test_regridding_through_the_sky(spark):
    """The same smooth sky on two grids: what one lacks is null, the rest agrees; on its own grid an image comes back."""
    a, b = World(20, 20, 1e-3, -1e-3, 0.3, 0.5), World(12, 12, 1.3e-3, -1.1e-3, 0.3 + 2e-3, 0.5 - 3e-3)
    value = lambda y, x: 3 + 40 * y + 25 * x  # linear in l and m of a
    yy, xx = np.mgrid[:41, :41]
    sky = value((yy - 20) * 1e-3, (xx - 20) * -1e-3)
    source, target = pixels(spark, {0: sky}), pixels(spark, {0: np.zeros((25, 25))})
    got = {(r.y, r.x): r.other for r in resample.regrid(source, target, a, b).collect()}
    assert len(got) == 625 and sum(v is None for v in got.values()) < 200
    for (y, x), v in got.items():
        l, m = (x - 12) * -1.1e-3, (y - 12) * 1.3e-3  # noqa: E741
        n = math.sqrt(1 - l * l - m * m)
        dec = math.asin(m * math.cos(b.dec) + n * math.sin(b.dec))
        ra = b.ra + math.atan2(l, n * math.cos(b.dec) - m * math.sin(b.dec))
        la, ma = math.cos(dec) * math.sin(ra - a.ra), math.sin(dec) * math.cos(a.dec) - math.cos(dec) * math.sin(a.dec) * math.cos(ra - a.ra)
        inside = abs(la) <= 20e-3 and abs(ma) <= 20e-3
        assert (v is not None) == inside
        if inside:
            assert v == pytest.approx(value(ma, la), abs=1e-9)
    same = resample.regrid(source, source, a, a).where("abs(other - value) > 1e-9").count()
    assert same == 0


def test_circles(spark):
    """A round beam keeps its profile; a circle off the square has none."""
    y, x = np.mgrid[:17, :17] - 8
    rows = [(f, p, int(j), int(i), float(math.exp(-(r2) / (40 * f)) * (1 if p < 2 else 0)), 0.0) for f in (1.0, 2.0) for p in range(4) for j, i, r2 in zip((y + 8).ravel(), (x + 8).ravel(), (x**2 + y**2).ravel())]
    beam = spark.createDataFrame(rows, "frequency double, pol int, y int, x int, re double, im double")
    got = {(r.frequency, r.radius): r.voltage for r in resample.circularise(beam, 8.0, 10, 16).collect()}
    for (f, r), v in got.items():
        assert v is None if r > 8 else v == pytest.approx(math.exp(-r * r / (40 * f)), abs=0.03)


def plain_arc(start, stop, pair, longitude, ra, dec):
    def basis(t):
        h = math.radians((280.46061837 + 360.98564736629 * (t / 86400 - 51544.5)) % 360) + longitude - ra
        return np.array([[math.sin(h), math.cos(h), 0], [-math.sin(dec) * math.cos(h), math.sin(dec) * math.sin(h), math.cos(dec)], [math.cos(dec) * math.cos(h), -math.cos(dec) * math.sin(h), math.sin(dec)]])

    axis = np.linalg.svd(basis(start + 3600) - basis(start))[0][:, 2]
    p, q = basis(start) @ pair, basis(stop) @ pair
    mid = p @ axis * axis
    return axis, mid, np.linalg.norm(p - mid), p, q


def test_arcs(spark):
    rng = np.random.default_rng(5)
    ants = {i: rng.normal(size=3) * 1000 for i in range(4)}
    antennas = spark.createDataFrame([(i, *map(float, v)) for i, v in ants.items()], "antenna_id int, x double, y double, z double")
    start = 59000 * 86400.0
    spans = [(start, start + 4 * 3600.0), (start + 9e5, start + 9e5 + 25 * 3600.0)]
    got = coverage.arcs(spark.createDataFrame(spans, "start double, stop double"), antennas, 0.4, 1.2, -0.6).collect()
    starts = sorted({r.start for r in got})
    assert len(got) == 6 * 5 and [b - a for a, b in zip(starts[1:], starts[2:])] == [25 * 900.0] * 3
    for r in got:
        stop = r.start + (4 * 3600.0 if r.start == start else 25 * 900.0)
        axis, mid, major, p, q = plain_arc(r.start, stop, ants[r.antenna2] - ants[r.antenna1], 0.4, 1.2, -0.6)
        assert (r.u, r.v) == (pytest.approx(mid[0], abs=1e-5), pytest.approx(mid[1], abs=1e-5)) and r.major == pytest.approx(major) and r.minor == pytest.approx(abs(axis[2]) * major, rel=1e-6)
        assert math.isclose(math.sin(2 * (r.angle - math.atan2(axis[1], axis[0]))), 0, abs_tol=1e-6)
        ends = {round(math.remainder(a + r.angle, 2 * math.pi), 5) for a in (r.angle0, r.angle1)}
        assert ends == {round(math.remainder(math.atan2(e[1] - mid[1], e[0] - mid[0]), 2 * math.pi), 5) for e in (p, q)}
        assert (r.angle1 - r.angle0) % (2 * math.pi) < math.pi


def test_short_intervals_stay(spark):
    d = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 39600.0), ("c", 0.0, 4 * 39600.0)], "name string, start double, stop double")
    got = {}
    for r in coverage.split_intervals(d).collect():
        got.setdefault(r.name, []).append((r.start, r.stop))
    assert sorted(got["a"]) == [(0.0, 10.0)] and len(got["b"]) == 2 and len(got["c"]) == 8 and all(s[1] - s[0] < 39600 for x in got.values() for s in x)
    assert feed.J2000 == 51544.5
