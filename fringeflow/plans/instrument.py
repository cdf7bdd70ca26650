"""Queries of the instrument's own operators, over samples that Spark derives from the tables, each with its SQL.

lineitem stands in for samples of four polarizations, orders for channels and times, nation for antennas. SQL repeats the arithmetic in the same order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.polarization import mueller
from ..operators import feed, polarize, primary_beam, resample, spill
from ..sources import dataset, visibility
from . import chain, relational

LINEAR, STOKES = ["XX", "XY", "YX", "YY"], ["I", "Q", "U", "V"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def main_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of lineitem as one of a measurement set: values of four polarizations in cents, a flag on the first."""
    d = _table(spark, sf_dir, "lineitem")
    cents, quantity = (F.round(F.col(c) * 100).cast("double") for c in ("l_extendedprice", "l_quantity"))
    number = lambda re, im: F.struct(re.alias("re"), im.alias("im"))
    weight = F.lit(1.0) + F.col("l_linenumber")
    return d.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), (F.lit(4.9e9) + F.col("l_linenumber")).alias("time"), (F.col("l_partkey") % 16).cast("int").alias("antenna1"), (F.col("l_orderkey") % 16).cast("int").alias("antenna2"),
        (F.col("l_suppkey") % 3).cast("int").alias("field_id"), F.lit(0).alias("data_desc_id"), F.lit(0).alias("observation_id"), (F.col("l_returnflag") == "A").alias("flag_row"),
        F.array("l_quantity", "l_extendedprice", "l_discount").alias("uvw", metadata={"unit": "km"}), F.array(number(cents, quantity), number(quantity, cents), number(quantity, -cents), number(-cents, quantity)).alias("data"),
        F.array(F.col("l_linestatus") == "O", F.lit(False), F.lit(False), F.lit(False)).alias("flag"), F.array(weight, weight + 1, weight + 2, weight + 3).alias("weight"), (F.col("l_suppkey") % 4).cast("int").alias("channel"),
    )


def write_set(spark: SparkSession, sf_dir: str) -> str:
    """A measurement set of lineitem in the shared folder: channels are folders."""
    path = f"{spill.shared_folder(spark).rstrip('/')}/set-{spark.range(1).select(F.uuid()).first()[0]}.ms"
    main_table(spark, sf_dir).write.partitionBy("channel").parquet(f"{path}/main")
    spark.range(3).select(F.col("id").cast("int").alias("field_id"), F.array(F.col("id") * 10.0, F.lit(-30.0)).alias("phase_dir", metadata={"unit": "deg"})).coalesce(1).write.parquet(f"{path}/field")
    spark.createDataFrame([(0, 0, 0)], "data_desc_id int, polarization_id int, spectral_window_id int").coalesce(1).write.parquet(f"{path}/data_description")
    return path


def _rows(samples: DataFrame) -> DataFrame:
    return samples.select("row_id", F.col("channel").cast("long").alias("channel"), F.posexplode(F.arrays_zip("re", "im", "weight")).alias("pol", "x")).select("row_id", "channel", F.col("pol").cast("long").alias("pol"), "x.re", "x.im", "x.weight")


def ms_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan of a measurement set: options, channel range, flags, sign and unit of uvw, flagged weights."""
    d = dataset.load(spark, write_set(spark, sf_dir), {"field": "1"}, 1, 3).samples()
    return d.select("row_id", F.col("channel").cast("long").alias("channel"), (F.col("antenna1") * 16 + F.col("antenna2")).cast("long").alias("baseline"), *"uvw", F.posexplode(F.arrays_zip("re", "im", "weight")).alias("pol", "x")).select("row_id", "channel", "baseline", *"uvw", F.col("pol").cast("long").alias("pol"), "x.re", "x.im", "x.weight")


def visibility_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same set through the data source, channels and field chosen by options before a task starts."""
    visibility.register(spark)
    d = spark.read.format("visibility").options(path=write_set(spark, sf_dir), start_channel="2", field="0").load()
    return d.where(~F.col("flag_row")).groupBy(F.col("channel").cast("long").alias("channel"), F.col("antenna1").cast("long").alias("antenna1")).agg(F.count("*").alias("n"), F.sum(F.col("data")[0]["re"].cast("long")).alias("re"), F.sum(F.when(F.col("flag")[0], 0).otherwise(F.col("weight")[0].cast("long"))).alias("weight"))


def mueller_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stokes parameters and weights of each sample; any zero weight drops it."""
    d = main_table(spark, sf_dir).select("row_id", "channel", F.col("data.re").alias("re"), F.col("data.im").alias("im"), F.zip_with("weight", "flag", lambda w, f: F.when(f, 0.0).otherwise(w)).alias("weight"))
    return _rows(polarize.apply(d, polarize.matrix(mueller(STOKES, LINEAR)))).withColumn("weight", F.round("weight", 9))


def mueller_parallactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stokes parameters of feeds at angles of tenths of a radian, by the circular frame; values to whole cents."""
    d = main_table(spark, sf_dir).where(~F.col("flag_row")).select("row_id", "channel", F.col("data.re").alias("re"), F.col("data.im").alias("im"), "weight", (F.col("antenna1") * 0.1).alias("a1"), (F.col("antenna2") * 0.1).alias("a2"))
    turned = polarize.apply(polarize.with_phases(d, F.col("a1"), F.col("a2")), polarize.parallactic(STOKES, LINEAR))
    whole = lambda c: (F.floor(F.col(c) + 0.5)).cast("long").alias(c)
    return _rows(turned).groupBy("channel", "pol").agg(F.count("*").alias("n"), F.sum(whole("re")).alias("re"), F.sum(whole("im")).alias("im"))


def feed_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallactic angle of each antenna at each time."""
    times = _table(spark, sf_dir, "orders").select((F.lit(4.9e9) + F.col("o_orderkey") * 60.0).alias("time"))
    east = F.col("n_nationkey") * 0.1
    antennas = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("antenna_id"), (5109000.0 * F.cos(east)).alias("x"), (5109000.0 * F.sin(east)).alias("y"), (-3239000.0 - F.col("n_regionkey") * 1000.0).alias("z"))
    got = feed.feed_angles(times, antennas, 0.5, -0.75)
    return got.select(F.col("time").cast("long").alias("time"), F.col("antenna").cast("long").alias("antenna"), F.round("angle", 6).alias("angle"))


BEAM = [(9.0e4, [1.0, 0.9, 0.7, 0.4, 0.1]), (1.5e5, [1.0, 0.8, 0.5, 0.2, 0.05]), (3.0e5, [1.0, 0.6, 0.2, 0.1, 0.0])]


def primary_beam_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of the primary beam for each order's frequency (its price) and radius (its customer); null outside the model."""
    model = spark.createDataFrame([(f, r, v) for f, c in BEAM for r, v in enumerate(c)], "frequency double, radius int, voltage double")
    d = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("channel"), F.col("o_totalprice").alias("frequency"), (F.col("o_custkey") % 500 * 0.01).alias("r"))
    got = d.join(primary_beam.radial(model, d.select("channel", "frequency")), "channel")
    p = primary_beam.power(F.col("voltages"), F.col("r"), 1.0)
    return got.select("channel", F.when(~F.isnan(p), F.round(p, 9)).alias("power"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    relational.register(spark, sf_dir)
    return spark.sql(f"WITH {relational.QUANT} SELECT channel, pol, u, v, sub_u, sub_v, w_plane, w_slice, CAST(re * wt AS DOUBLE) AS re, CAST(im * wt AS DOUBLE) AS im, CAST(wt AS DOUBLE) AS weight FROM c")


def spill_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records stored in buckets and read back in blocks of 100: blocks, records and weight of each part."""
    name = spill.write(_records(spark, sf_dir), spill.shared_folder(spark))
    with spill.in_place(spark):
        each = spill.blocks(spill.read(spark, name), 100).groupBy(*spill.PART, "block").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
        out = spill.checkpoint(each.groupBy(*spill.PART).agg(F.count("*").alias("blocks"), F.max("n").alias("largest"), F.sum("n").alias("records"), F.sum("weight").cast("long").alias("weight")).select("channel", "w_slice", F.col("band").cast("long").alias("band"), "blocks", "largest", "records", "weight"))
    spill.drop(spark, name)
    return out


def weights_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thermal noise by robust weights, and its ratio to that of natural ones."""
    got = chain.weights_noise(chain.weigh(_records(spark, sf_dir), "robust"), "robust")
    return got.select("channel", *[F.round(c, 9).alias(c) for c in ("weights_noise", "normalized_noise")])


SOURCE, TARGET = resample.World(4.0, 4.0, 1e-2, -1e-2, 0.1, 0.2), resample.World(3.5, 4.25, 9e-3, -1.1e-2, 0.1025, 0.1975)


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    relational.register(spark, sf_dir, ["embeddings"])
    return spark.sql(f"WITH {relational.SPARK_PIX} SELECT img, y, x, CAST(v AS DOUBLE) AS value FROM px")


def regrid_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image on the pixels of another that looks a little aside and finer: what both have there, and their difference."""
    px = _pixels(spark, sf_dir)
    got = resample.regrid(px, px, SOURCE, TARGET)
    return got.select("img", "y", "x", F.round("other", 5).alias("other"), F.round(F.col("other") - F.col("value"), 5).alias("difference"))


def circularise_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image as a beam: its mean voltage on circles about the pixel (4, 4)."""
    px = _pixels(spark, sf_dir).select(F.col("img").alias("frequency"), F.lit(0).alias("pol"), "y", "x", F.col("value").alias("re"), F.lit(0.0).alias("im"))
    got = resample.circularise(px, 4.0, 5, 16)
    return got.select("frequency", F.col("radius").cast("long").alias("radius"), F.round("voltage", 5).alias("voltage"))


QUERIES = {f.__name__: f for f in (ms_samples, visibility_scan, mueller_samples, mueller_parallactic, feed_angle, primary_beam_power, spill_blocks, weights_noise, regrid_world, circularise_beam)}

_MAIN = """main AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, CAST(l_suppkey % 4 AS BIGINT) AS channel, CAST(l_partkey % 16 AS BIGINT) AS a1, CAST(l_orderkey % 16 AS BIGINT) AS a2, l_suppkey % 3 AS field, l_returnflag = 'A' AS flag_row,
    l_linestatus = 'O' AS flag, l_quantity, l_extendedprice, l_discount, CAST(round(l_extendedprice * 100) AS DOUBLE) AS c, CAST(round(l_quantity * 100) AS DOUBLE) AS q, 1e0 + l_linenumber AS w FROM lineitem)"""
_EACH = """each AS (SELECT *, CASE p WHEN 0 THEN c WHEN 1 THEN q WHEN 2 THEN q ELSE -c END AS re, CASE p WHEN 0 THEN q WHEN 1 THEN c WHEN 2 THEN -c ELSE q END AS im, CASE WHEN p = 0 AND flag THEN 0e0 ELSE w + p END AS weight FROM main, generate_series(0, 3) t(p))"""
_DEGREE = f"{math.pi / 180:.17e}"
_E2, _SECOND = 1 - (feed.MINOR / feed.MAJOR) ** 2, (feed.MAJOR / feed.MINOR) ** 2 - 1
_PAIRS = ", ".join(f"({f!r}, {g!r}, {r}, {a!r}, {b!r})" for (f, c), (g, d) in zip(BEAM, BEAM[1:]) for r, (a, b) in enumerate(zip(c, d)))

_NEAR = """f AS (SELECT *, CAST(floor(sy) AS BIGINT) AS fy, CAST(floor(sx) AS BIGINT) AS fx FROM s),
      k AS (SELECT f.*, fy + a AS cy, fx + b AS cx, CASE WHEN a = 1 THEN sy - fy ELSE 1e0 - (sy - fy) END * CASE WHEN b = 1 THEN sx - fx ELSE 1e0 - (sx - fx) END AS share FROM f, generate_series(0, 1) g(a), generate_series(0, 1) h(b)),
      c AS (SELECT * FROM k WHERE share > 0)"""


def _sin_cos(w: resample.World) -> tuple[str, str]:
    return f"{math.sin(w.dec)!r}e0", f"{math.cos(w.dec)!r}e0"


_SD, _CD = _sin_cos(TARGET)
_SD0, _CD0 = _sin_cos(SOURCE)

ORACLE_SQL = {
    "regrid_world": f"""WITH {relational.DUCK_PIX}, p AS (SELECT y, x, (x - {TARGET.x0}e0) * {TARGET.step_x}e0 AS l, (y - {TARGET.y0}e0) * {TARGET.step_y}e0 AS m FROM generate_series(0, 7) g(y), generate_series(0, 7) h(x)),
      q AS (SELECT y, x, l, m, sqrt(1e0 - l * l - m * m) AS n FROM p), w AS (SELECT y, x, atan2(l, n * {_CD} - m * {_SD}) + {TARGET.ra}e0 AS ra, asin(m * {_CD} + n * {_SD}) AS de FROM q),
      s AS (SELECT y, x, (sin(de) * {_CD0} - cos(de) * cos(ra - {SOURCE.ra}e0) * {_SD0}) / {SOURCE.step_y}e0 + {SOURCE.y0}e0 AS sy, cos(de) * sin(ra - {SOURCE.ra}e0) / {SOURCE.step_x}e0 + {SOURCE.x0}e0 AS sx FROM w), {_NEAR},
      o AS (SELECT i.img, c.y, c.x, CASE WHEN count(i2.v) = count(*) THEN sum(i2.v * share) END AS other FROM (SELECT DISTINCT img FROM px) i CROSS JOIN c LEFT JOIN px i2 ON i2.img = i.img AND i2.y = c.cy AND i2.x = c.cx GROUP BY i.img, c.y, c.x)
      SELECT o.img, o.y, o.x, round(other, 5) AS other, round(other - px.v, 5) AS difference FROM o JOIN px ON px.img = o.img AND px.y = o.y AND px.x = o.x""",
    "circularise_beam": f"""WITH {relational.DUCK_PIX}, s AS (SELECT r, k, round(r * sin(k * {2 * math.pi / 16!r}e0) + 4e0, 9) AS sy, round(r * cos(k * {2 * math.pi / 16!r}e0) + 4e0, 9) AS sx FROM generate_series(0, 4) g(r), generate_series(0, 15) h(k)), {_NEAR},
      o AS (SELECT i.img, c.r, c.k, CASE WHEN count(i2.v) = count(*) THEN sum(i2.v * share) END AS v FROM (SELECT DISTINCT img FROM px) i CROSS JOIN c LEFT JOIN px i2 ON i2.img = i.img AND i2.y = c.cy AND i2.x = c.cx GROUP BY i.img, c.r, c.k)
      SELECT img AS frequency, r AS radius, round(CASE WHEN count(v) = count(*) THEN sqrt(sum(v * v) * (5e-1 / 16)) END, 5) AS voltage FROM o GROUP BY img, r""",
    "ms_samples": f"WITH {_MAIN}, {_EACH} SELECT row_id, channel, a1 * 16 + a2 AS baseline, -1e0 * (l_quantity * 1e3) AS u, -1e0 * (l_extendedprice * 1e3) AS v, -1e0 * (l_discount * 1e3) AS w, p AS pol, re, im, weight FROM each WHERE field = 1 AND NOT flag_row AND a1 <> a2 AND channel >= 1 AND channel < 3",
    "visibility_scan": f"WITH {_MAIN} SELECT channel, a1 AS antenna1, count(*) AS n, CAST(sum(c) AS BIGINT) AS re, CAST(sum(CASE WHEN flag THEN 0 ELSE w END) AS BIGINT) AS weight FROM main WHERE field = 0 AND channel >= 2 AND NOT flag_row GROUP BY channel, a1",
    # I and Q of the outer two, U and V of the inner two, whose weights are w + 1 and w + 2; the outer ones' are w and w + 3
    "mueller_samples": f"""WITH {_MAIN} SELECT row_id, channel, p AS pol, CASE p WHEN 0 THEN (c + -c) / 2e0 WHEN 1 THEN (c - -c) / 2e0 WHEN 2 THEN (q + q) / 2e0 ELSE (c - -c) / 2e0 END + 0e0 AS re,
      CASE p WHEN 0 THEN (q + q) / 2e0 WHEN 1 THEN (q - q) / 2e0 WHEN 2 THEN (c + -c) / 2e0 ELSE -(q - q) / 2e0 END + 0e0 AS im,
      round(1e0 / CASE WHEN p < 2 THEN 25e-2 / w + 25e-2 / (w + 3e0) ELSE 25e-2 / (w + 1e0) + 25e-2 / (w + 2e0) END, 9) AS weight FROM main, generate_series(0, 3) t(p) WHERE NOT flag""",
    # RR, RL, LR and LL of the linear ones, turned by difference and sum of the angles
    "mueller_parallactic": f"""WITH {_MAIN}, r AS (SELECT channel, c, q, cos(a1 * 1e-1 - a2 * 1e-1) AS dc, sin(a1 * 1e-1 - a2 * 1e-1) AS ds, cos(a1 * 1e-1 + a2 * 1e-1) AS sc, sin(a1 * 1e-1 + a2 * 1e-1) AS ss FROM main WHERE NOT flag_row),
      s AS (SELECT *, 0e0 AS i_re, q AS i_im, c AS q_re, 0e0 AS q_im, q AS u_re, 0e0 AS u_im, c AS v_re, 0e0 AS v_im FROM r),
      t AS (SELECT channel, (i_re + v_re) * dc - (i_im + v_im) * ds AS rr_re, (i_re + v_re) * ds + (i_im + v_im) * dc AS rr_im, (i_re - v_re) * dc + (i_im - v_im) * ds AS ll_re, (i_im - v_im) * dc - (i_re - v_re) * ds AS ll_im,
        (q_re - u_im) * sc - (q_im + u_re) * ss AS rl_re, (q_re - u_im) * ss + (q_im + u_re) * sc AS rl_im, (q_re + u_im) * sc + (q_im - u_re) * ss AS lr_re, (q_im - u_re) * sc - (q_re + u_im) * ss AS lr_im FROM s),
      o AS (SELECT channel, p, CASE p WHEN 0 THEN (rr_re + ll_re) / 2e0 WHEN 1 THEN (rl_re + lr_re) / 2e0 WHEN 2 THEN (rl_im - lr_im) / 2e0 ELSE (rr_re - ll_re) / 2e0 END AS re,
        CASE p WHEN 0 THEN (rr_im + ll_im) / 2e0 WHEN 1 THEN (rl_im + lr_im) / 2e0 WHEN 2 THEN -(rl_re - lr_re) / 2e0 ELSE (rr_im - ll_im) / 2e0 END AS im FROM t, generate_series(0, 3) g(p))
      SELECT channel, p AS pol, count(*) AS n, CAST(sum(CAST(floor(re + 5e-1) AS BIGINT)) AS BIGINT) AS re, CAST(sum(CAST(floor(im + 5e-1) AS BIGINT)) AS BIGINT) AS im FROM o GROUP BY channel, p""",
    "feed_angle": f"""WITH t AS (SELECT DISTINCT 49e8 + o_orderkey * 6e1 AS time FROM orders), a AS (SELECT n_nationkey AS antenna, 5109e3 * cos(n_nationkey * 1e-1) AS x, 5109e3 * sin(n_nationkey * 1e-1) AS y, -3239e3 - n_regionkey * 1e3 AS z FROM nation),
      b AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {feed.MAJOR!r}e0, sqrt(x * x + y * y) * {feed.MINOR!r}e0) AS t FROM a),
      c AS (SELECT antenna, atan2(y, x) AS lon, atan2(z + {_SECOND * feed.MINOR!r}e0 * (sin(t) * sin(t) * sin(t)), p - {_E2 * feed.MAJOR!r}e0 * (cos(t) * cos(t) * cos(t))) AS lat FROM b),
      h AS (SELECT time, antenna, lat, ({feed.SIDEREAL!r}e0 + {feed.DAILY - 360!r}e0 * (time / 864e2 - {feed.J2000!r}e0) + 36e1 * (time / 864e2 - floor(time / 864e2)) + 18e1) % 36e1 * {_DEGREE} + lon - 5e-1 AS h FROM t CROSS JOIN c)
      SELECT CAST(time AS BIGINT) AS time, CAST(antenna AS BIGINT) AS antenna, round(atan2(sin(h), tan(lat) * {math.cos(-0.75)!r}e0 - {math.sin(-0.75)!r}e0 * cos(h)), 6) AS angle FROM h""",
    "primary_beam_power": f"""WITH b(f, g, r, a, b) AS (VALUES {_PAIRS}), o AS (SELECT o_orderkey AS channel, CAST(o_totalprice AS DOUBLE) AS fr, o_custkey % 500 * 1e-2 AS r FROM orders),
      v AS (SELECT o.channel, o.r, b.r AS k, min_by(a + (b - a) * ((fr - f) / (g - f)), f) AS volt FROM o JOIN b ON fr >= f AND fr <= g AND b.r >= o.r - 1e0 AND b.r <= o.r + 1e0 GROUP BY o.channel, o.r, b.r),
      p AS (SELECT l.channel, l.volt + (h.volt - l.volt) * (l.r - floor(l.r)) AS volt FROM v l JOIN v h ON h.channel = l.channel AND l.k = CAST(floor(l.r) AS INT) AND h.k = CAST(floor(l.r) AS INT) + 1)
      SELECT o.channel, round(p.volt * p.volt, 9) AS power FROM o LEFT JOIN p ON p.channel = o.channel""",
    "spill_blocks": f"WITH {relational.QUANT}, p AS (SELECT channel, w_slice, CAST(floor(v / {spill.BAND}e0) AS BIGINT) AS band, count(*) AS n, CAST(sum(wt) AS BIGINT) AS weight FROM c GROUP BY 1, 2, 3) SELECT channel, w_slice, band, CAST(ceil(n / 1e2) AS BIGINT) AS blocks, least(n, 100) AS largest, n AS records, weight FROM p",
    "weights_noise": f"""WITH {relational.CELLS}, m AS (SELECT channel, CAST(sum(w * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS mean FROM grid WHERE pol = 0 GROUP BY channel), d AS (SELECT g.channel, w, 1e0 / (25e0 / mean * w + 1e0) AS d FROM grid g JOIN m ON m.channel = g.channel WHERE pol = 0)
      SELECT channel, round(sqrt(sum(w * d * d)) / sum(w * d), 9) AS weights_noise, round(sqrt(sum(w * d * d)) / sum(w * d) * sqrt(sum(w)), 9) AS normalized_noise FROM d GROUP BY channel""",
}
