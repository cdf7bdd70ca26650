"""SEFD, statistics of targets, metadata and pages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.functions import sefd
from fringeflow.operators import report


def test_sefd(spark):
    d = spark.createDataFrame([(1.2e9,), (0.8e9,), (1.7e9,)], "f double")
    m = sefd.model_of("L")
    got = [r[0] for r in d.select(m.at(F.col("f"))).collect()]
    each = [np.polynomial.polynomial.polyval(1200.0, c) for c in m.coefficients]
    assert got[0] == pytest.approx(math.sqrt(np.mean(np.square(each)))) and all(map(math.isnan, got[1:]))
    assert d.select(m.at(F.col("f"), True)).first()[0] == pytest.approx(got[0] / 0.96)
    with pytest.raises(ValueError):
        sefd.model_of("S")
    noise = lambda n, t: d.select(sefd.thermal_noise(F.lit(400.0), n, F.lit(t), F.lit(1e4))).first()[0]
    assert noise(64, 3600.0) == pytest.approx(400 / math.sqrt(2 * 64 * 63 * 3600 * 1e4)) and noise(1, 3600.0) is None and noise(64, 0.0) is None


def test_time_on_target(spark):
    states = ["track", "track", "slew", "track", "track", "track"]
    scans = spark.createDataFrame([(i, 100.0 + 4 * i, s, 0 if i < 4 else 1) for i, s in enumerate(states)], "dump long, time double, state string, target_id int")
    assert {r.target_id: (r.seconds, r.hours) for r in report.on_target(scans, 4.0).collect()} == {0: (12.0, 12 / 3600), 1: (8.0, 8 / 3600)}
    assert sorted((r.target_id, r.start, r.stop) for r in report.intervals(scans, 4.0).collect()) == [(0, 98.0, 106.0), (0, 110.0, 114.0), (1, 114.0, 122.0)]


def test_channel_statistics(spark):
    channels = spark.createDataFrame([(c, 1e9 + c, 1e4) for c in range(4)], "channel long, frequency double, width double")
    output = spark.createDataFrame([(0,), (1,), (2,)], "channel long")
    status = spark.createDataFrame([("t", 0, "complete"), ("t", 1, "no-data"), ("u", 2, "complete")], "target string, channel long, status string")
    stats = spark.createDataFrame([("t", 0, "I", 2.0, 0.1, None, 1.2, 5.0), ("t", 0, "V", 2.0, 0.1, None, 1.2, 0.5), ("u", 2, "I", 9.0, 9.0, 9.0, 9.0, 9.0)], "target string, channel long, pol string, peak double, noise double, weights_noise double, normalized_noise double, total double")
    got = report.channel_statistics(channels, output, status, stats, "t", sefd.model_of("L"), 64, 3600.0).orderBy("channel")
    rows = got.collect()
    assert [r.status for r in rows] == ["complete", "no-data", "failed", "masked"]
    assert (rows[0].peak, rows[0].noise, rows[0].total_I, rows[0].total_V) == (2.0, 0.1, 5.0, 0.5)
    assert math.isnan(rows[0].weights_noise) and math.isnan(rows[0].total_Q) and math.isnan(rows[2].peak) and rows[3].model_noise > 0
    assert {r.status: r.channels for r in report.counts(got).collect()} == {"complete": 1, "no-data": 1, "failed": 1, "masked": 1, None: 4}
    text = report.page("a <run>", {"counts": report.counts(got), "channels": got})
    assert "<title>a &lt;run&gt;</title>" in text and text.count("<tr>") == 5 + 1 + 4 + 1 and "no-data" in text
    with pytest.raises(ValueError):
        report.page("x", {"channels": got}, rows=3)


def test_metadata(spark):
    targets = spark.createDataFrame([(0, "a", "a, radec", math.pi, -math.pi / 6)], "target_id int, name string, description string, ra double, dec double")
    seconds = spark.createDataFrame([(0, 7200.0)], "target_id int, seconds double")
    about = report.metadata(targets, {"observer": "me"}, 100, 1e4, seconds, "image", "2020-01-01T00:00:00")
    assert about["DecRa"] == ["-30.0000000000,180.0000000000"] and about["IntegrationTime"] == [2.0] and about["Bandwidth"] == 1e6 and about["Description"] == "UNKNOWN: image" and about["Observer"] == "me"
    assert '"StartTime": "2020-01-01T00:00:00Z"' in report.as_json(about)
    with pytest.raises(ValueError):
        report.as_json({"x": math.nan})


def test_prefixes(spark):
    d = spark.createDataFrame([(0.0123,), (1.0,), (4.5e10,), (0.0,), (-2e-6,), (1000.0,)], "v double")
    assert [r[0] for r in d.select(report.si(F.col("v"), "Jy")).collect()] == ["12.3 mJy", "1.00 Jy", "45.0 GJy", "0.00 Jy", "-2.00 µJy", "1.00 kJy"]


def test_pointing(spark):
    """A source at the place's own declination stands overhead when it crosses the meridian, and sinks by the time."""
    d = spark.createDataFrame([(59000 * 86400.0 + 600.0 * k,) for k in range(145)], "time double")
    x, y, z = 6378137.0 * math.cos(0.3), 6378137.0 * math.sin(0.3), 0.0
    rows = report.pointing(d, x, y, z, 1.0, 0.0).orderBy("time").collect()
    high = max(r.elevation for r in rows)
    assert math.pi / 2 - high < math.radians(2.5) and min(r.elevation for r in rows) < -1.5
    at = next(i for i, r in enumerate(rows) if r.elevation == high)
    # on the equator a source of declination 0 rises in the east and sets in the west: the zenith stands to its west, then to its east
    assert rows[at - 10 if at >= 10 else at + 130].parallactic == pytest.approx(-math.pi / 2, abs=1e-6) and rows[at + 10 if at + 10 < 145 else at - 130].parallactic == pytest.approx(math.pi / 2, abs=1e-6)
