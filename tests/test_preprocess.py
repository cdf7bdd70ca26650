"""Polarizations as arrays, feed angles, compression and the store of records."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.functions.polarization import feed_phases, mueller
from fringeflow.operators import feed, polarize, preprocess, spill

LINEAR, STOKES = ["XX", "XY", "YX", "YY"], ["I", "Q", "U", "V"]
ARRAYS = "row_id long, channel int, time double, antenna1 int, antenna2 int, u double, v double, w double, re array<double>, im array<double>, weight array<double>, feed_angle1 double, feed_angle2 double"


def random_samples(spark, n=60):
    rng = np.random.default_rng(11)
    rows = [(i, i % 2, 1.0, 0, 1, *map(float, rng.normal(size=3)), rng.normal(size=4).tolist(), rng.normal(size=4).tolist(), rng.uniform(0.5, 2, 4).tolist(), *map(float, rng.uniform(-3, 3, 2))) for i in range(n)]
    return rows, spark.createDataFrame(rows, ARRAYS)


def check(got, rows, matrix_of):
    assert len(got) == len(rows)
    for r in got:
        row = rows[r.row_id]
        m = matrix_of(row)
        np.testing.assert_allclose(np.array(r.re) + 1j * np.array(r.im), m @ (np.array(row[8]) + 1j * np.array(row[9])), atol=1e-12)
        np.testing.assert_allclose(r.weight, 1 / (np.abs(m) ** 2 @ (1 / np.array(row[10]))), rtol=1e-12)


def test_stokes_of_all_polarizations_and_channels(spark):
    rows, d = random_samples(spark)
    m = mueller(STOKES, LINEAR)
    check(polarize.apply(d, polarize.matrix(m)).collect(), rows, lambda row: m)


def test_feeds_are_turned_in_the_circular_frame(spark):
    rows, d = random_samples(spark)
    out, into = polarize.circular_pair(STOKES, LINEAR)
    got = polarize.apply(polarize.with_phases(d, F.col("feed_angle1"), F.col("feed_angle2")), polarize.parallactic(STOKES, LINEAR)).collect()
    check(got, rows, lambda row: out @ (feed_phases(np.array(row[11]), np.array(row[12]))[:, None] * into))
    with pytest.raises(ValueError):
        polarize.circular_pair(STOKES, ["XX", "YY"])


def test_weights_and_values_that_spoil(spark):
    """Any zero weight drops a sample; 0 x inf takes nothing; a value that isn't finite loses its weight, and the sample goes if that is the first output."""
    inf, nan = math.inf, math.nan
    cases = [([1.0, 2.0], [1.0, 0.0]), ([1.0, inf], [1.0, 1.0]), ([nan, 1.0], [1.0, 1.0]), ([1.0, 2.0], [-0.0, 1.0]), ([1.0, 2.0], [-2.0, 1.0]), (None, [1.0, 1.0]), ([1.0, 2.0], [None, 1.0])]
    d = spark.createDataFrame([(i, 0, 0.0, 0, 1, 1.0, 1.0, 1.0, re, None if re is None else [0.0, 0.0], w, 0.0, 0.0) for i, (re, w) in enumerate(cases)], ARRAYS)
    got = {r.row_id: (r.re, r.weight) for r in polarize.apply(d, polarize.matrix(np.eye(2))).collect()}
    assert got == {1: ([1.0, 0.0], [1.0, 0.0]), 4: ([1.0, 2.0], [2.0, 1.0])}


def plain_key(u, v, w, cell, oversample, planes, slices, most):
    if w < 0:
        u, v, w = -u, -v, -w
    su, sv = (math.floor(x / cell * oversample) for x in (u, v))
    p = min(int(w * (slices - 0.5) * planes / most + planes / 2), slices * planes - 1)
    return su // oversample, sv // oversample, su % oversample, sv % oversample, p % planes, p // planes


def test_compression(spark):
    rng = np.random.default_rng(6)
    base = rng.uniform(-40, 40, size=(40, 3))
    at = np.repeat(base, 5, axis=0)  # each place five times, so that sums are of several
    rows = [(k % 2, k % 3, *map(float, x), float(1 + k % 4), float(k), float(-k), 0.75, 3, 8, 30.0) for k, x in enumerate(at)]
    d = spark.createDataFrame(rows, "channel long, pol long, u double, v double, w double, weight double, re double, im double, cell_size double, w_slices int, w_planes int, max_w double")
    want = {}
    for c, p, u, v, w, weight, re, im, *_ in rows:
        key = (c, p, *plain_key(u, v, w, 0.75, 4, 8, 3, 30.0))
        s = want.setdefault(key, [0.0, 0.0, 0.0])
        for i, x in enumerate((weight, weight * re, weight * im * (-1 if w < 0 else 1))):
            s[i] += x
    got = preprocess.compress(preprocess.quantize(d, 4)).collect()
    assert {(r.channel, r.pol, r.u, r.v, r.sub_u, r.sub_v, r.w_plane, r.w_slice): [r.weight, r.re, r.im] for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    assert any(k[-2:] == (7, 2) for k in want)  # beyond max_w: the last plane


def test_store(spark, tmp_path):
    """Reading back gives what was written; sums by more than a part's keys move nothing; blocks are as long as asked but for a part's last."""
    rows = [(c, s, v, u, 0, 0, 0, 0, float(u)) for c in range(3) for s in range(2) for v in range(-70, 130, 5) for u in range(4)]
    d = spark.createDataFrame(rows, "channel long, w_slice long, v long, u long, sub_u int, sub_v int, w_plane int, pol int, weight double")
    name = spill.write(d, str(tmp_path), 4)
    stored = spill.read(spark, name)
    with spill.in_place(spark):
        assert sorted(map(tuple, stored.select(d.columns).collect())) == sorted(map(tuple, d.collect()))
        summed = stored.groupBy(*spill.PART, "u").agg(F.sum("weight").alias("s"))
        assert "Exchange" not in summed._jdf.queryExecution().executedPlan().toString()
        assert {(r.channel, r.w_slice): r.records for r in spill.lengths(stored).collect()} == {(c, s): 160 for c in range(3) for s in range(2)}
        sizes = spill.blocks(stored, 7).groupBy(*spill.PART, "block").count().collect()
        by_part = {}
        for r in sizes:
            by_part.setdefault((r.channel, r.w_slice, r.band), {})[r.block] = r["count"]
        for part in by_part.values():
            assert sorted(part) == list(range(len(part))) and all(part[b] == 7 for b in range(len(part) - 1)) and 0 < part[len(part) - 1] <= 7
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    spill.drop(spark, name)
    assert not list(tmp_path.iterdir()) and not spark.catalog.tableExists(name)


def test_feed_angles(spark):
    """Against a plain computation by vectors: the angle at the source from the pole to the zenith."""
    lat, lon, dec, ra = map(math.radians, (-30.7, 21.4, -45.0, 60.0))
    n = feed.MAJOR / math.sqrt(1 - (1 - (feed.MINOR / feed.MAJOR) ** 2) * math.sin(lat) ** 2)
    height = 1050.0
    x, y, z = (n + height) * math.cos(lat) * math.cos(lon), (n + height) * math.cos(lat) * math.sin(lon), (n * (feed.MINOR / feed.MAJOR) ** 2 + height) * math.sin(lat)
    times = [59000 * 86400.0 + k * 3600.0 for k in range(0, 24, 5)]
    antennas = spark.createDataFrame([(4, x, y, z)], "antenna_id int, x double, y double, z double")
    receptors = spark.createDataFrame([(4, 0.25)], "antenna_id int, angle double")
    got = {r.time: r.angle for r in feed.feed_angles(spark.createDataFrame([(t,) for t in times * 2], "time double"), antennas, ra, dec, receptors).collect()}
    assert sorted(got) == times
    for t in times:
        turn = math.radians((280.46061837 + 360.98564736629 * (t / 86400 - 51544.5)) % 360)
        zenith = np.array([math.cos(lat) * math.cos(turn + lon), math.cos(lat) * math.sin(turn + lon), math.sin(lat)])
        source = np.array([math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)])
        north = np.array([0, 0, 1]) - source * source[2]
        east = np.cross([0, 0, 1], source)
        want = math.atan2(zenith @ east / np.linalg.norm(east), zenith @ north / np.linalg.norm(north))
        assert math.remainder(got[t] - 0.25 - want, 2 * math.pi) == pytest.approx(0, abs=1e-8)
    samples = spark.createDataFrame([(times[0], 4, 4, "s")], "time double, antenna1 int, antenna2 int, more string")
    row = feed.with_feed_angles(samples, feed.feed_angles(samples, antennas, ra, dec)).first()
    assert row.feed_angle1 == row.feed_angle2 == pytest.approx(got[times[0]] - 0.25)
