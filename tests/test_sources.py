"""Loaders, the visibility source, units and metadata."""

import math

import pytest
from pyspark.sql import functions as F

from fringeflow.sources import dataset, visibility

MAIN = "row_id long, time double, antenna1 int, antenna2 int, field_id int, data_desc_id int, observation_id int, flag_row boolean, uvw array<double>, data array<struct<re: double, im: double>>, flag array<boolean>, weight array<double>, channel int"


def with_unit(df, **units):
    return df.select(*[F.col(c).alias(c, metadata={"unit": units[c]}) if c in units else F.col(c) for c in df.columns])


@pytest.fixture(scope="module")
def ms(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "set.MS")
    rows = []
    for c in range(3):
        for i in range(12):
            rows.append((i, 4.9e9 + i // 3, i % 3, (i + 1) % 3 if i != 5 else i % 3, i % 2, 0, 7, i == 8, [0.1 * i, 0.2, -0.3], [(float(i), float(c)), (1.0, -1.0)], [i == 2, False], [2.0, 3.0], c))
    with_unit(spark.createDataFrame(rows, MAIN), uvw="km").write.partitionBy("channel").parquet(f"{path}/main")
    small = {
        "antenna": with_unit(spark.createDataFrame([(i, f"m{i:03d}", [float(i), 0.0, 2.0 * i], 1350.0) for i in range(3)], "antenna_id int, name string, position array<double>, dish_diameter double"), dish_diameter="cm"),
        "field": with_unit(spark.createDataFrame([(0, [10.0, -20.0]), (1, [1.0, 2.0])], "field_id int, phase_dir array<double>"), phase_dir="deg"),
        "data_description": spark.createDataFrame([(0, 4, 9)], "data_desc_id int, polarization_id int, spectral_window_id int"),
        "spectral_window": with_unit(spark.createDataFrame([(8, "none", [1.0]), (9, "L", [1000.0, 1001.0, 1002.0])], "spectral_window_id int, name string, chan_freq array<double>"), chan_freq="MHz"),
        "polarization": spark.createDataFrame([(3, ["I"]), (4, ["XX", "YY"])], "polarization_id int, corr_type array<string>"),
        "feed": spark.createDataFrame([(i, [0.1 * i, 0.1 * i]) for i in range(3)], "antenna_id int, receptor_angle array<double>"),
        "observation": spark.createDataFrame([(7, "me", "there"), (8, "x", "y")], "observation_id int, observer string, telescope string"),
    }
    for name, d in small.items():
        d.write.parquet(f"{path}/{name}")
    return path


def test_samples_of_a_measurement_set(spark, ms):
    d = dataset.load(spark, ms, {"field": "0"}, 1, 3)
    got = {(r.row_id, r.channel): r for r in d.samples().collect()}
    # even rows are of the field; 8 is flagged as a whole; row 5, an autocorrelation, is of the other field
    assert set(got) == {(i, c) for i in (0, 2, 4, 6, 10) for c in (1, 2)}
    r = got[2, 1]
    assert [r.u, r.v, r.w] == pytest.approx([-200.0, -200.0, 300.0]) and r.re == [2.0, 1.0] and r.im == [1.0, -1.0] and r.weight == [0.0, 3.0]
    strict = dataset.load(spark, ms, {"uvw": "strict"}).samples().where("row_id = 2 and channel = 0").first()
    assert strict.w == pytest.approx(-300.0)
    assert dataset.load(spark, ms, {"field": "1"}).samples().where("row_id = 5").count() == 0
    assert {r.row_id for r in d.limited(2).collect()} == {0, 2}


def test_metadata_of_a_measurement_set(spark, ms):
    d = dataset.load(spark, ms, {}, 1)
    assert {r.channel: r.frequency for r in d.frequencies().collect()} == {1: 1.001e9, 2: 1.002e9} and d.band() == "L" and d.polarizations() == ["XX", "YY"]
    assert d.phase_centre() == pytest.approx((math.radians(10), math.radians(-20)))
    assert [r.diameter for r in d.antennas().orderBy("antenna_id").collect()] == pytest.approx([13.5] * 3)
    assert dataset.longest_baseline(d.antennas()) == pytest.approx(2 * math.sqrt(5))
    assert {r.antenna_id: r.angle for r in d.receptor_angles().collect()} == pytest.approx({0: 0.0, 1: 0.1, 2: 0.2})
    head = d.headers().first()
    # rows 0, 2, 4, 6, 10: times 0, 0, 1, 2, 3 s, each once
    assert head.date_avg == "2014-02-24T23:06:41.500" and (head.observer, head.telescope) == ("me", "there") and head.obsgeo_z == pytest.approx(2.0)


def test_options_are_checked(spark, ms):
    for options in ({"field": "2"}, {"data_desc": "1"}, {"data": "corrected"}, {"uvw": "other"}, {"pol_frame": "x"}, {"colour": "red"}):
        with pytest.raises(ValueError):
            dataset.load(spark, ms, options)
    for start, stop in ((-1, None), (2, 2), (3, 1)):
        with pytest.raises(ValueError):
            dataset.load(spark, ms, {}, start, stop)
    with pytest.raises(ValueError):
        dataset.load(spark, "/data/set.fits")
    assert dataset.MeasurementSet.match("/a/b.Ms/") and dataset.Archive.match("redis://host/1") and dataset.Archive.match("https://x/y.rdb?z") and not dataset.Archive.match("http://[bad")


def test_units():
    assert dataset.UNITS["angle"]["arcsec"] == pytest.approx(math.radians(1 / 3600))


def test_units_of_another_kind_raise(spark):
    d = with_unit(spark.createDataFrame([(1.0,)], "x double"), x="Hz")
    with pytest.raises(ValueError):
        dataset.in_unit(d, "x", "length")


def test_times_and_directions(spark):
    d = spark.createDataFrame([(40587 * 86400.0 + 1.25, 1.25, math.pi / 2, -math.pi / 4)], "mjd double, unix double, ra double, dec double")
    r = d.select(dataset.iso_time(F.col("mjd")).alias("a"), dataset.iso_time(F.col("unix"), mjd=False).alias("b"), dataset.direction_text(F.col("ra"), F.col("dec")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("1970-01-01T00:00:01.250",) * 2 + ("90.0000000000, -45.0000000000",)


def test_visibility_source(spark, ms):
    visibility.register(spark)
    read = lambda **o: spark.read.format("visibility").options(path=ms, **o).load()
    everything = read()
    assert everything.count() == 36
    some = read(start_channel="1", stop_channel="2", field="1")
    assert {(r.channel, r.field_id) for r in some.collect()} == {(1, 1)} and some.count() == 6
    assert some.rdd.getNumPartitions() < everything.rdd.getNumPartitions()
    where = "channel = 2 and field_id = 0 and not flag_row and time > 0"
    rows = {0, 2, 4, 6, 10}
    assert {r.row_id for r in everything.where(where).collect()} == rows
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:  # a load for each query
        pushed = read(push_filters="true").where(where).select("row_id", "data")
        assert {r.row_id for r in pushed.collect()} == rows and pushed.rdd.getNumPartitions() < everything.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert read(start_channel="7").count() == 0
    same = spark.read.parquet(f"{ms}/main").select(everything.columns)
    assert everything.exceptAll(same).count() == 0 and same.exceptAll(everything).count() == 0
    for options in ({"field": "9"}, {"start_channel": "2", "stop_channel": "1"}, {"data": "none"}):
        with pytest.raises(Exception, match="range|column"):
            read(**options).count()


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "set.rdb")
    names = ["m000", "m001", "m002"]
    products, k = [], 0
    for a, b in ((0, 1), (0, 2), (1, 1)):
        for pa, pb in ("hh", "hv", "vh", "vv"):
            if (a, b, pa, pb) != (0, 2, "v", "h"):  # one is missing
                products.append((k, names[a] + pa, names[b] + pb))
                k += 1
    vis = [(d, c, p, float(p), float(c), 2.0, d == 1 and p == 0) for d in range(4) for c in range(3) for p, *_ in products]
    tables = {
        "vis": (vis, "dump int, channel int, product int, re double, im double, weight double, flag boolean"),
        "corr_products": (products, "product int, input1 string, input2 string"),
        "antenna": ([(i, n, [0.0, 0.0, 0.0], 13.5) for i, n in enumerate(names)], "antenna_id int, name string, position array<double>, dish_diameter double"),
        "channels": ([(c, 1e9 + c) for c in range(3)], "channel int, frequency double"),
        "targets": ([(0, "cal", ["c"], ["bpcal"], 0.0, 0.0), (1, "other", [], [], 0.0, 0.0), (2, "source", ["J1"], ["target"], 0.0, 0.0)], "target_id int, name string, aliases array<string>, tags array<string>, ra double, dec double"),
        "scans": ([(0, 10.0, "slew", 2), (1, 11.0, "track", 2), (2, 12.0, "track", 2), (3, 13.0, "track", 1)], "dump int, time double, state string, target_id int"),
        "masks": ([(1e9 + 1.5, 1e9 + 2)], "low double, high double"),
        "uvw": ([(d, a, float(a), 10.0 * a, 100.0 * a * d) for d in range(4) for a in range(3)], "dump int, antenna_id int, u double, v double, w double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}")
    return path


def test_samples_of_an_archive(spark, archive):
    d = dataset.load(spark, archive)
    assert d.target()["name"] == "source"
    got = {(r.time, r.channel, r.antenna1, r.antenna2): r for r in d.samples().collect()}
    assert set(got) == {(t, c, 0, b) for t in (11.0, 12.0) for c in range(3) for b in (1, 2)}
    r = got[12.0, 1, 0, 2]
    assert (r.u, r.v, r.w) == (2.0, 20.0, 400.0) and r.re == [4.0, 5.0, 0.0, 6.0] and r.weight == [2.0, 2.0, 0.0, 2.0]
    assert got[11.0, 0, 0, 1].weight == [0.0, 2.0, 2.0, 2.0] and got[12.0, 2, 0, 1].weight == [0.0] * 4
    assert {r.channel: r.enabled for r in d.enabled().collect()} == {0: True, 1: True, 2: False}


def test_targets_of_an_archive(spark, archive):
    for wanted, name in (("1", "other"), ("cal", "cal"), ("J1", "source")):
        assert dataset.load(spark, archive, {"target": wanted}).target()["name"] == name
    with pytest.raises(ValueError):
        dataset.load(spark, archive, {"target": "nowhere"}).target()


def test_samples_by_baseline(spark, ms):
    d = dataset.by_baseline(dataset.load(spark, ms).samples(), 3)
    seen = {}
    for part in d.rdd.glom().collect():
        for r in part:
            seen.setdefault(r.channel, []).append((r.baseline, r.time))
    assert set(seen) == {0, 1, 2} and all(v == sorted(v) for v in seen.values())
