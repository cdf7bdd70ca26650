"""Options, profiling, beams, and small readers."""

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from fringeflow.functions import options, profiling
from fringeflow.functions.polarization import parse_stokes, unparse_stokes
from fringeflow.operators.imaging import Beam
from fringeflow.sources import dataset


@dataclasses.dataclass
class Settings:
    input_file: str = ""
    pixel_size: float = 1.0
    stokes: str = "I"
    host: bool = False
    degrid: bool = True
    products: tuple = ()
    names: list = dataclasses.field(default_factory=list)


def test_options_that_differ():
    s = Settings("x y.ms", 2.5, host=True, degrid=False)
    assert options.unparse(s, exclude=("input_file",)) == ["--pixel-size=2.5", "--host", "--no-degrid"]
    assert options.history(s) == "Command line options: '--input-file=x y.ms' --pixel-size=2.5 --host --no-degrid"
    s.products = ("a", "b")
    with pytest.raises(TypeError):
        options.unparse(s)
    assert options.unparse(Settings(products=("a", "b")), by_type={tuple: lambda n, v: [f"--{n}={x}" for x in v]}) == ["--products=a", "--products=b"]
    assert options.unparse(Settings(stokes="IV"), by_name={"stokes": lambda n, v: ["-s", v]}) == ["-s", "IV"] and options.unparse(Settings(names=[])) == []


def test_profile(spark, tmp_path):
    ticks = iter(range(100))
    p = profiling.Profiler(spark, lambda: float(next(ticks)))

    @p.profile(labels=("channel",))
    def work(channel):
        with p.step("inner", channel=channel + 10):
            assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "run;work;inner"
        return channel

    with p.step("run", start=0):
        assert work(channel=3) == 3 and work(channel=4) == 4
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    rows = p.records(spark)
    assert [r.labels for r in rows.where("size(stack) = 3").orderBy("start").collect()] == [{"start": "0", "channel": "13"}, {"start": "0", "channel": "14"}]
    # run: 0 to 9, work: 1 to 4 and 5 to 8, inner: 2 to 3 and 6 to 7
    assert {r.stack: r.seconds for r in profiling.exclusive(rows).collect()} == {"run": 3.0, "run;work": 4.0, "run;work;inner": 2.0}
    profiling.write_flamegraph(rows, str(tmp_path / "flame"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "flame")).collect()) == ["run 3000000", "run;work 4000000", "run;work;inner 2000000"]


def test_a_step_that_fails_is_recorded(spark):
    p = profiling.Profiler()
    with pytest.raises(KeyError), p.step("a"):
        raise KeyError
    assert [r[0] for r in p.rows] == [["a"]]


def test_beam():
    s = math.sqrt(8 * math.log(2))
    assert Beam.of(3.0, 2.0, 4.0) == pytest.approx((3 * s, 2 * s, 4.0 - math.pi)) and Beam.of(2.0, 3.0, 3.0) == pytest.approx((3 * s, 2 * s, 3.0 - math.pi / 2))


def test_stokes_there_and_back():
    assert unparse_stokes(parse_stokes("VIQ")) == "IQV"


def test_antennas_and_beams_of_files(spark, tmp_path):
    (tmp_path / "ants").write_text("# names\n\nm000, -30:42, 21:26, 1035.0, 13.5, -8.25 -207.3 8.6 5872.5\nm001,-30:42,21:26,1035.0,13.5, 1.1 -171.7 8.5\n")
    assert sorted(map(tuple, dataset.load_antennas(spark, str(tmp_path / "ants")).collect())) == [("m000", 13.5, -8.25, -207.3, 8.6), ("m001", 13.5, 1.1, -171.7, 8.5)]
    rows = [("L", 0.01, f, r, 1.0 - 0.1 * r) for f in (1000.0, 1100.0) for r in range(3)] + [("UHF", s, 600.0, 0, 1.0) for s in (0.1, 0.2)]
    d = spark.createDataFrame(rows, "band string, step double, frequency double, radius int, voltage double")
    d.withColumn("frequency", F.col("frequency").alias("frequency", metadata={"unit": "MHz"})).write.parquet(str(tmp_path / "beams"))
    beam, step = dataset.load_beam(spark, str(tmp_path / "beams"), "L")
    assert step == 0.01 and {r.frequency for r in beam.collect()} == {1.0e9, 1.1e9} and beam.count() == 6
    for band in ("UHF", "S"):
        with pytest.raises(ValueError):
            dataset.load_beam(spark, str(tmp_path / "beams"), band)
