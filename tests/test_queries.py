import re

import duckdb
import numpy as np
import pytest

import __spark_entry__
from fringeflow.operators import imaging, spill
from fringeflow.plans import instrument, relational
from fringeflow.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE_SQL = relational.QUERIES | instrument.QUERIES, relational.ORACLE_SQL | instrument.ORACLE_SQL


@pytest.mark.parametrize("name", ["any_zero_weight", "compress_group", "density_robust", "weighted_grid", "degrid_k3", "grid_kernel", "degrid_kernel", "compress_runlength", "distinct_inverse", "equal_spacing", "dft_grid_to_image", "find_peak", "find_peak_noise_gated", "target_intervals", "split_long_intervals", *instrument.QUERIES])
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_sql_is_text_of_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(imaging.QUERIES))
def test_images(spark, name):
    assert imaging.QUERIES[name](spark, DATA).count() > 0


def test_degridding_deals_records_once(spark):
    """Records go to blocks of the grid's rows and are summed there; rows of sub-cells and taps are dealt nowhere after the records are compressed."""
    with spill.in_place(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = QUERIES["degrid_kernel"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not [keys for keys in dealt if "sub_" in keys] and sum("block" in keys for keys in dealt) == 2


def test_prediction_takes_all_channels_and_sources(spark):
    """Every occupied cell of every channel, against a plain sum over all rows of part."""
    cells = {(r.channel, r.u, r.v) for r in QUERIES["uvw_fold_quantize"](spark, DATA).select("channel", "u", "v").distinct().collect()}
    got = QUERIES["predict_direct"](spark, DATA).toPandas()
    assert set(zip(got.channel, got.u, got.v)) == cells and len(got) == len(cells) and set(got.channel) == {0, 1, 2, 3}
    part = spark.read.parquet(f"{DATA}/part.parquet").toPandas()
    l, m = part.p_size.to_numpy() * 1e-4, (part.p_partkey.to_numpy() % 7 - 3) * 1e-4
    want = np.exp(-2j * np.pi * (np.outer(got.u, l) + np.outer(got.v, m))) @ part.p_retailprice.to_numpy()
    np.testing.assert_allclose(got.re + 1j * got.im, want, atol=2e-3)


def fixture(spark, folder, **tables):
    """Files of ``tables`` (rows, schema) in a new folder, the others as they are."""
    for t in TABLES:
        if t in tables:
            spark.createDataFrame(*tables[t]).write.parquet(f"{folder}/{t}.parquet")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    return str(folder)


def test_pairs_of_all_antennas(spark, tmp_path):
    ids = [3, 64, 65, 70, 900]
    sf = fixture(spark, tmp_path, supplier=([(i, i % 3, float(i * i)) for i in ids], "s_suppkey long, s_nationkey int, s_acctbal double"))
    assert sorted(map(tuple, QUERIES["all_pairs_uvw"](spark, sf).collect())) == [(a, b, float(b * b - a * a), (b % 3 - a % 3) * 100.0) for a in ids for b in ids if a < b]


def test_pairs_are_dealt_by_blocks(spark, tmp_path, monkeypatch):
    """Ten antennas in blocks of four: nine tasks, each of a pair of blocks, where one task made all pairs before."""
    monkeypatch.setattr(relational, "BLOCK", 4)
    sf = fixture(spark, tmp_path, supplier=([(i, 0, float(i)) for i in range(10)], "s_suppkey long, s_nationkey int, s_acctbal double"))
    got = QUERIES["all_pairs_uvw"](spark, sf)
    assert got.rdd.getNumPartitions() == 9
    assert sorted((r.a1, r.a2) for r in got.collect()) == [(a, b) for a in range(10) for b in range(a + 1, 10)]


def test_pairs_of_a_task_are_alike(spark, tmp_path, monkeypatch):
    """Blocks are ranges of x, by nation: a task has differences of two ranges of four, and v rises for an antenna; blocks were dealt at random before."""
    monkeypatch.setattr(relational, "BLOCK", 4)
    sf = fixture(spark, tmp_path, supplier=([(i, i % 3, i * 7 % 16 * 1.0) for i in range(16)], "s_suppkey long, s_nationkey int, s_acctbal double"))
    tasks = [t for t in QUERIES["all_pairs_uvw"](spark, sf).rdd.glom().collect() if t]
    assert sorted((r.a1, r.a2) for t in tasks for r in t) == [(a, b) for a in range(16) for b in range(a + 1, 16)]
    for t in tasks:
        assert max(r.u for r in t) - min(r.u for r in t) <= 6
        assert all(p.a1 != q.a1 or p.v <= q.v for p, q in zip(t, t[1:]))


@pytest.mark.parametrize("rows", [[], [(1, 2, 3.0)], [(i, None, None if i < 3 else float("nan")) for i in range(6)], [(i, 0, 5.0) for i in range(9)]])
def test_pairs_of_odd_antennas(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(relational, "BLOCK", 4)
    sf = fixture(spark, tmp_path, supplier=(rows, "s_suppkey long, s_nationkey int, s_acctbal double"))
    got = QUERIES["all_pairs_uvw"](spark, sf).collect()
    assert sorted((r.a1, r.a2) for r in got) == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0]]


def test_default_only_without_status(spark, tmp_path):
    sf = fixture(spark, tmp_path, events=([(i, f"type{i}") for i in range(6)], "event_id long, event_type string"), orders=([(i,) for i in range(8)], "o_orderkey long"))
    assert dict(map(tuple, QUERIES["status_left_default"](spark, sf).collect())) == {i: f"type{i}" for i in range(6)} | {6: "failed", 7: "masked"}


def test_intervals_are_halved_until_short(spark, tmp_path):
    spans = [0, 1099, 1100, 2199, 2200, 4399, 4400, 9000]
    sf = fixture(spark, tmp_path, events=([(i, 7 + e) for i, n in enumerate(spans) for e in (0, n)], "user_id long, event_id long"))
    got = {}
    for r in QUERIES["split_long_intervals"](spark, sf).collect():
        got.setdefault(r.user_id, []).append((r.start, r.stop))
    for i, span in enumerate(spans):
        pieces = 1
        while span / pieces >= 1100:
            pieces *= 2
        assert sorted(got[i]) == [(7 + span * k / pieces, 7 + span * (k + 1) / pieces) for k in range(pieces)]


def test_pieces_are_dealt(spark, tmp_path):
    """Users' intervals are dealt before they are split: few small rows become many, all in one task before."""
    sf = fixture(spark, tmp_path, events=([(i, e) for i in range(40) for e in (0, 9000)], "user_id long, event_id long"))
    tasks = [len(rows) for rows in QUERIES["split_long_intervals"](spark, sf).rdd.glom().collect()]
    assert sum(tasks) == 40 * 16 and sum(n > 0 for n in tasks) == 4


def test_gated_peak_counts_behind_the_beam(spark, tmp_path):
    """Of noise 1.4826 and a limit of 11.1195, a corner's 12 falls behind the beam, the centre's passes; only noise gives no peak."""
    def image(**at):
        v = np.where(np.arange(64) % 2, 1.0, -1.0)
        for k, x in at.items():
            v[int(k[1:])] = x
        return v.tolist()

    images = [image(), image(p0=-12.0), image(p36=12.0), image(p0=-90.0, p36=12.0), image(p36=11.0)]
    sf = fixture(spark, tmp_path, embeddings=([(i, v, 0) for i, v in enumerate(images)], "vec_id long, embedding array<float>, label int"))
    got = {r.img: r.peak for r in QUERIES["find_peak_noise_gated"](spark, sf).collect()}
    assert got == {0: None, 1: None, 2: 120000, 3: 900000, 4: None}


def test_beam_and_clean_take_the_whole_image(spark, tmp_path):
    """A rotated ellipse of any peak is fitted; no fit where nothing or one pixel clears the threshold; CLEAN goes on past 50 cycles."""
    y, x = np.mgrid[-4:4, -4:4]
    a, b, one = x * np.cos(0.6) + y * np.sin(0.6), -x * np.sin(0.6) + y * np.cos(0.6), np.zeros((8, 8))
    one[4, 4] = 1
    images = [5 * np.exp(-(a**2 / 8 + b**2 / 2)), one * 0, one, sum(k * np.exp(-((x - k) ** 2 + (y + k) ** 2) / 2) for k in (-3, 1, 2))]
    sf = fixture(spark, tmp_path, embeddings=([(i, v.ravel().tolist(), 0) for i, v in enumerate(images)], "vec_id long, embedding array<float>, label int"))
    beam = {(r.img, r.x): r.value for r in imaging.QUERIES["fit_beam"](spark, sf).collect()}
    np.testing.assert_allclose([beam[0, k] for k in range(3)], [2 * np.sqrt(8 * np.log(2)), np.sqrt(8 * np.log(2)), np.pi / 2 - 0.6], rtol=1e-3)
    assert all(beam[i, k] is None for i in (1, 2) for k in range(3))
    left = [abs(r.value) for r in imaging.QUERIES["clean_residual"](spark, sf).where("img = 3").collect()]
    model = {(r.y, r.x): r.value for r in imaging.QUERIES["clean_minor_loop"](spark, sf).where("img = 3").collect()}
    assert max(left) < 1e-3 and all(abs(model[4 - k, 4 + k] - k) < 1e-2 for k in (-3, 1, 2))
