"""Relational operators of the imaging pipeline as SQL plans.

Spark and DuckDB run the same text but for how an array is unrolled. Sums are
over integers where order could show, so results are equal to the last digit.
The tables stand in for instrument data: lineitem for visibilities, embeddings
for 8 x 8 images, events for dumps, supplier for antennas, part for sources,
orders for frequency channels.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.kernels import w_kernel
from ..operators.spill import checkpoint
from ..sources.tables import TABLES, register

VIS = """vis AS (
  SELECT l_orderkey, l_suppkey % 4 AS channel, l_partkey % 16 AS ant1, l_orderkey % 16 AS ant2, CAST(l_linenumber % 4 AS BIGINT) AS pol,
         (l_quantity - 255e-1) * 37e-1 AS u, (l_extendedprice / 1e3 - 25e0) * 29e-1 AS v, (l_discount - 5e-2) * 2e3 + l_tax * 1e2 AS w,
         l_returnflag = 'A' AS flag, CAST(round(l_extendedprice * 100) AS BIGINT) AS re, CAST(round(l_quantity * 100) AS BIGINT) AS im,
         CAST(1 + l_linenumber AS BIGINT) AS wt
  FROM lineitem)"""
# w >= 0 by conjugation, eight sub-cells a cell, 3 w slices of 4 planes up to 200
QUANT = f"""{VIS}, fold AS (
  SELECT channel, pol, CASE WHEN w < 0 THEN -u ELSE u END AS u, CASE WHEN w < 0 THEN -v ELSE v END AS v, abs(w) AS w, re, CASE WHEN w < 0 THEN -im ELSE im END AS im, wt
  FROM vis WHERE NOT flag AND ant1 <> ant2
), q AS (
  SELECT channel, pol, CAST(floor(u * 8e0) AS BIGINT) AS us, CAST(floor(v * 8e0) AS BIGINT) AS vs, CAST(least(floor(w * 25e-1 * 4e0 / 2e2 + 2e0), 11e0) AS BIGINT) AS ws, re, im, wt FROM fold
), c AS (
  SELECT channel, pol, CAST(floor(us / 8e0) AS BIGINT) AS u, CAST(floor(vs / 8e0) AS BIGINT) AS v, us - 8 * CAST(floor(us / 8e0) AS BIGINT) AS sub_u, vs - 8 * CAST(floor(vs / 8e0) AS BIGINT) AS sub_v,
         ws % 4 AS w_plane, CAST(floor(ws / 4e0) AS BIGINT) AS w_slice, re, im, wt FROM q
)"""
# records by all their keys, what every later step starts from; Spark writes them once
COMPRESSED = """compressed AS (SELECT channel, pol, u, v, sub_u, sub_v, w_plane, w_slice, CAST(sum(re * wt) AS BIGINT) AS re, CAST(sum(im * wt) AS BIGINT) AS im, CAST(sum(wt) AS BIGINT) AS wt,
         CAST(sum(re) AS BIGINT) AS model_re, CAST(sum(im) AS BIGINT) AS model_im FROM c GROUP BY channel, pol, u, v, sub_u, sub_v, w_plane, w_slice)"""
# density of robust weights in hundredths
WEIGHED = """grid AS (SELECT channel, pol, u, v, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im, CAST(sum(wt) AS BIGINT) AS w FROM compressed GROUP BY channel, pol, u, v),
      mean AS (SELECT channel, CAST(sum(w * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS mean_w FROM grid WHERE pol = 0 GROUP BY channel),
      d AS (SELECT g.channel, g.pol, g.u, g.v, g.re, g.im, CAST(floor(1e2 / (g.w * (25e0 / m.mean_w) + 1e0) + 5e-1) AS BIGINT) AS d FROM grid g JOIN mean m ON m.channel = g.channel)"""
CELLS = f"""{QUANT}, grid AS (SELECT channel, pol, u, v, CAST(sum(wt) AS BIGINT) AS w FROM c GROUP BY channel, pol, u, v)"""
MEAN = f"""{CELLS}, mean AS (SELECT channel, CAST(sum(w * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS mean_w FROM grid WHERE pol = 0 GROUP BY channel)"""
PIX = "PIXELS"
SPARK_PIX = "px AS (SELECT vec_id AS img, CAST(label AS BIGINT) AS pol, CAST(floor(p / 8e0) AS BIGINT) AS y, CAST(p % 8 AS BIGINT) AS x, CAST(round(CAST(e AS DOUBLE) * 1e4) AS BIGINT) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, e)"
DUCK_PIX = "px AS (SELECT vec_id AS img, CAST(label AS BIGINT) AS pol, CAST(floor(p / 8e0) AS BIGINT) AS y, CAST(p % 8 AS BIGINT) AS x, CAST(round(CAST(embedding[p + 1] AS DOUBLE) * 1e4) AS BIGINT) AS v FROM embeddings, generate_series(0, 63) t(p))"
SPARK_PIECES, DUCK_PIECES = "(SELECT /*+ REPARTITION(TASKS) */ * FROM h) LATERAL VIEW explode(sequence(CAST(0 AS BIGINT), n - 1)) t AS k", "h, unnest(range(n)) t(k)"
TAPS = "taps AS (SELECT 0 AS j, 1 AS k UNION ALL SELECT 1, 2 UNION ALL SELECT 2, 1)"


def kernel_rows(planes: int = 4, oversample: int = 8, taps: int = 8, cell: float = 10.0, step: float = 50.0) -> str:
    """A row (w plane, sub-cell, tap, re, im) for each tap of the w kernels, in hundredths; planes x oversample x taps rows, whatever the data."""
    rows = []
    for p in range(planes):
        k = w_kernel(cell, (p - planes / 2 + 0.5) * step, 7, oversample, taps, 4)
        k = np.round(100 * k / np.abs(k).max()) + 0.0
        rows += [f"({p}, {s}, {j + 1 - taps // 2}, {k[s, j].real:.0f}, {k[s, j].imag:.0f})" for s in range(oversample) for j in range(taps)]
    return ", ".join(rows)


KERNEL = f"k(p, s, j, re, im) AS (VALUES {kernel_rows()})"
#: Grid columns of a block, a kernel's width at least: records and the model's cells that they reach meet by blocks of a grid row.
SPAN = 16


def degrid_text(taps: int = 8) -> str:
    """``degrid_kernel`` as Spark runs it: each record's row of taps along v is one row of columns, records meet the cells in reach where they are dealt to, and are
    summed there. Integer sums, so the order of the two directions doesn't show."""
    js = range(1 - taps // 2, taps - taps // 2 + 1)
    columns = lambda rows, value: ", ".join(f"CAST(sum(CASE WHEN j = {j} THEN {rows}.{part} ELSE 0 END) AS BIGINT) AS {value[part]}{i}" for i, j in enumerate(js) for part in ("re", "im"))
    total = lambda *terms: " ".join(f"{sign} m.{m}{i} * b.{k}{i}" for i in range(taps) for sign, m, k in terms).removeprefix("+ ")
    block = lambda u: f"CAST(floor(({u}) / {SPAN}e0) AS BIGINT)"
    return f"""WITH COMPRESSED, {KERNEL}, kv AS (SELECT p, s, {columns("k", {"re": "c", "im": "d"})} FROM k GROUP BY p, s),
      model AS (SELECT channel, pol, u, v, CAST(sum(model_re) AS BIGINT) AS re, CAST(sum(model_im) AS BIGINT) AS im FROM compressed GROUP BY channel, pol, u, v),
      near AS (SELECT channel, pol, u, v - j AS v, {columns("model", {"re": "x", "im": "y"})} FROM model CROSS JOIN (VALUES {", ".join(f"({j})" for j in js)}) n(j) GROUP BY channel, pol, u, v - j),
      m AS (SELECT *, explode(array_distinct(array({block(f"u - {js[-1]}")}, {block(f"u - {js[0]}")}))) AS block FROM near), z AS (SELECT *, {block("u")} AS block FROM compressed),
      f AS (SELECT /*+ BROADCAST(a, b) */ z.*, a.re AS kre, a.im AS kim, {total(("+", "x", "c"), ("-", "y", "d"))} AS tre, {total(("+", "x", "d"), ("+", "y", "c"))} AS tim
            FROM z JOIN m ON m.channel = z.channel AND m.pol = z.pol AND m.v = z.v AND m.block = z.block AND m.u BETWEEN z.u + {js[0]} AND z.u + {js[-1]}
            JOIN kv b ON b.p = z.w_plane AND b.s = z.sub_v JOIN k a ON a.p = z.w_plane AND a.s = z.sub_u AND a.j = m.u - z.u)
      SELECT channel, w_slice, w_plane, pol, u, v, sub_u, sub_v, wt AS weight, re * 10000 - wt * CAST(sum(tre * kre - tim * kim) AS BIGINT) AS re, im * 10000 - wt * CAST(sum(tre * kim + tim * kre) AS BIGINT) AS im
      FROM f GROUP BY channel, pol, v, block, u, sub_u, sub_v, w_plane, w_slice, wt, re, im"""


#: Rows of a block: windows run over blocks of ids, and over one row a block; pairs are made of two blocks.
BLOCK = 4096


def before_each(rows: str, key: str, value: str, name: str, first: str) -> str:
    """CTEs ``name`` (key, before): the ``value`` of the row of ``rows`` with the next smaller key, by windows over blocks of keys and over one row a block."""
    return f"""{name}_b AS (SELECT {key}, {value} AS x, CAST(floor({key} / {BLOCK}e0) AS BIGINT) AS sup FROM {rows}),
      {name}_e AS (SELECT sup, max_by(x, {key}) AS x FROM {name}_b GROUP BY sup), {name}_p AS (SELECT sup, lag(x) OVER (ORDER BY sup) AS x FROM {name}_e),
      {name}_w AS (SELECT {key}, sup, row_number() OVER (PARTITION BY sup ORDER BY {key}) AS k, lag(x) OVER (PARTITION BY sup ORDER BY {key}) AS x FROM {name}_b),
      {name} AS (SELECT w.{key}, CASE WHEN w.k = 1 THEN p.x ELSE w.x END AS {first} FROM {name}_w w JOIN {name}_p p ON p.sup = w.sup)"""


def sum_before(rows: str, key: str, value: str, name: str) -> str:
    """CTEs ``name`` (key, base): the sum of ``value`` over the rows of ``rows`` with smaller keys, in two levels too."""
    return f"""{name}_b AS (SELECT {key}, {value} AS x, CAST(floor({key} / {BLOCK}e0) AS BIGINT) AS sup FROM {rows}),
      {name}_e AS (SELECT sup, sum(x) AS x FROM {name}_b GROUP BY sup), {name}_p AS (SELECT sup, sum(x) OVER (ORDER BY sup) - x AS x FROM {name}_e),
      {name} AS (SELECT b.{key}, p.x + sum(b.x) OVER (PARTITION BY b.sup ORDER BY b.{key}) - b.x AS base FROM {name}_b b JOIN {name}_p p ON p.sup = b.sup)"""


def marked(value: str) -> str:
    """CTE of events with 1 where ``value`` is another than that of the event before in a block of ids."""
    return f"""b AS (SELECT event_id, {value} AS x, CAST(floor(event_id / {BLOCK}e0) AS BIGINT) AS blk FROM events),
      e AS (SELECT event_id, x, blk, CASE WHEN x <> lag(x) OVER (PARTITION BY blk ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM b)"""


#: A row a block: its first and last value, and how often the value changes in it. Spark writes it once.
BLOCKS = "blocks AS (SELECT blk, min_by(x, event_id) AS x0, max_by(x, event_id) AS x1, sum(new) AS c FROM e GROUP BY blk)"


def runs(value: str) -> str:
    """CTEs that number the runs of equal ``value`` in the order of event_id: within blocks of ids, then over blocks, and over blocks of blocks."""
    return f"""MARKED {value} {before_each("blocks", "blk", "x1", "prev", "x")},
      s AS (SELECT t.blk, CASE WHEN t.x0 = p.x THEN 0 ELSE 1 END AS first, c + CASE WHEN t.x0 = p.x THEN 0 ELSE 1 END AS c FROM blocks t JOIN prev p ON p.blk = t.blk), {sum_before("s", "blk", "c", "o")},
      r AS (SELECT e.event_id, e.x, CAST(o.base + s.first + sum(e.new) OVER (PARTITION BY e.blk ORDER BY e.event_id) AS BIGINT) AS run FROM e JOIN o ON o.blk = e.blk JOIN s ON s.blk = e.blk)"""


#: Eight places of an axis, and sums of an image's rows at each of them.
ALONG_X = """n(o) AS (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT)), (CAST(3 AS BIGINT)), (CAST(4 AS BIGINT)), (CAST(5 AS BIGINT)), (CAST(6 AS BIGINT)), (CAST(7 AS BIGINT))),
      a AS (SELECT img, px.y, n.o AS x, sum(v * cos(7853981633974483e-16 * ((n.o - 4) * (px.x - 4)))) AS c, sum(v * sin(7853981633974483e-16 * ((n.o - 4) * (px.x - 4)))) AS s FROM px CROSS JOIN n GROUP BY img, px.y, n.o)"""
BEAM = "beam AS (SELECT DISTINCT y, x, 1e0 / (1e0 + 5e-2 * ((y - 4) * (y - 4) + (x - 4) * (x - 4))) AS b FROM px)"

SQL = {
    "scan_filter_project": f"WITH {VIS} SELECT channel, ant1 * 16 + ant2 AS baseline, pol, re, im FROM vis WHERE NOT flag AND ant1 <> ant2 AND channel >= 1 AND channel < 3",
    "flag_weight_fold": f"WITH {VIS} SELECT channel, pol, CAST(sum(CASE WHEN flag THEN 0 ELSE wt END) AS BIGINT) AS weight, count(*) AS n FROM vis GROUP BY channel, pol",
    "any_zero_weight": f"WITH {VIS} SELECT l_orderkey, channel, count(*) AS n_pols FROM vis GROUP BY l_orderkey, channel HAVING min(CASE WHEN flag THEN 0 ELSE wt END) > 0",
    "uvw_fold_quantize": f"WITH {QUANT} SELECT channel, pol, u, v, sub_u, sub_v, w_plane, w_slice, re, im, wt FROM c",
    "mueller_static": f"""WITH {VIS}, m AS (SELECT 0 AS o, 0 AS i, 1 AS k UNION ALL SELECT 0, 3, 1 UNION ALL SELECT 1, 0, 1 UNION ALL SELECT 1, 3, -1 UNION ALL SELECT 2, 1, 1 UNION ALL SELECT 2, 2, 1)
      SELECT channel, m.o AS out_pol, CAST(sum(m.k * re) AS BIGINT) AS re2, CAST(sum(m.k * im) AS BIGINT) AS im2, round(1e0 / sum(abs(m.k) * 1e0 / wt), 9) AS weight FROM vis JOIN m ON m.i = vis.pol GROUP BY channel, m.o""",
    "compress_group": f"WITH {QUANT} SELECT channel, pol, u, v, sub_u, sub_v, w_plane, w_slice, CAST(sum(re * wt) AS BIGINT) AS re, CAST(sum(im * wt) AS BIGINT) AS im, CAST(sum(wt) AS BIGINT) AS weight FROM c GROUP BY channel, pol, u, v, sub_u, sub_v, w_plane, w_slice",
    "compress_runlength": f"WITH {runs('event_type')} SELECT run, min(x) AS event_type, min(event_id) AS first_id, count(*) AS n FROM r GROUP BY run",
    "compression_ratio": f"WITH {QUANT}, k AS (SELECT channel, count(*) AS n FROM c GROUP BY channel, pol, u, v, sub_u, sub_v, w_plane, w_slice) SELECT channel, CAST(sum(n) AS BIGINT) AS n_in, count(*) AS n_out FROM k GROUP BY channel",
    "slice_offsets": f"WITH {QUANT}, k AS (SELECT channel, w_slice, count(*) AS n FROM c GROUP BY channel, w_slice) SELECT channel, w_slice, n, CAST(sum(n) OVER (PARTITION BY channel ORDER BY w_slice) - n AS BIGINT) AS first_row FROM k",
    "grid_weights": f"WITH {CELLS} SELECT channel, pol, u + 100 AS u, v + 100 AS v, w FROM grid",
    "mean_weight": f"WITH {MEAN} SELECT channel, round(mean_w, 9) AS mean_w FROM mean",
    "density_natural": f"WITH {CELLS} SELECT channel, pol, u, v, 1 AS density FROM grid",
    "density_uniform": f"WITH {CELLS} SELECT channel, round(sqrt(sum(1e0 / w)) / count(*), 9) AS rms, round(sqrt(sum(1e0 / w)) / count(*) * sqrt(sum(w)), 9) AS normalized_rms FROM grid WHERE pol = 0 AND w > 0 GROUP BY channel",
    "density_robust": f"WITH {MEAN} SELECT g.channel, pol, u, v, round(1e0 / (w * (25e0 / mean_w) + 1e0), 9) AS density FROM grid g JOIN mean m ON m.channel = g.channel",
    "weighted_grid": f"WITH COMPRESSED, {WEIGHED} SELECT channel, pol, u, v, re * d AS re, im * d AS im, d AS density FROM d",
    # separable kernel: taps along u are summed before those along v; conjugate kernel, density and weight multiplied in
    "grid_kernel": f"""WITH COMPRESSED, {KERNEL}, {WEIGHED},
      z AS (SELECT c.channel, w_slice, w_plane, c.pol, c.u, c.v, sub_u, sub_v, c.re * d.d AS re, c.im * d.d AS im FROM compressed c JOIN d ON d.channel = c.channel AND d.pol = c.pol AND d.u = c.u AND d.v = c.v),
      a AS (SELECT channel, w_slice, w_plane, pol, u + j AS u, v, sub_v, CAST(sum(z.re * k.re + z.im * k.im) AS BIGINT) AS re, CAST(sum(z.im * k.re - z.re * k.im) AS BIGINT) AS im
            FROM z JOIN k ON k.p = z.w_plane AND k.s = z.sub_u GROUP BY channel, w_slice, w_plane, pol, u + j, v, sub_v)
      SELECT channel, w_slice, pol, u, v + j AS v, CAST(sum(a.re * k.re + a.im * k.im) AS BIGINT) AS re, CAST(sum(a.im * k.re - a.re * k.im) AS BIGINT) AS im
      FROM a JOIN k ON k.p = a.w_plane AND k.s = a.sub_v GROUP BY channel, w_slice, pol, u, v + j""",
    # each record's prediction from the model grid by the same kernel, along v and then along u; the residual is the record less weight x prediction, in units of 1e-4
    "degrid_kernel": f"""WITH COMPRESSED, {KERNEL}, model AS (SELECT channel, pol, u, v, CAST(sum(model_re) AS BIGINT) AS re, CAST(sum(model_im) AS BIGINT) AS im FROM compressed GROUP BY channel, pol, u, v),
      pts AS (SELECT DISTINCT channel, w_plane, pol, u, v, sub_u, sub_v FROM compressed),
      need AS (SELECT DISTINCT channel, w_plane, pol, u + j AS gu, v, sub_v FROM pts JOIN k ON k.p = pts.w_plane AND k.s = pts.sub_u),
      r AS (SELECT n.channel, n.w_plane, n.pol, n.gu, n.v, n.sub_v, CAST(sum(m.re * k.re - m.im * k.im) AS BIGINT) AS re, CAST(sum(m.re * k.im + m.im * k.re) AS BIGINT) AS im
            FROM need n JOIN k ON k.p = n.w_plane AND k.s = n.sub_v JOIN model m ON m.channel = n.channel AND m.pol = n.pol AND m.u = n.gu AND m.v = n.v + k.j GROUP BY n.channel, n.w_plane, n.pol, n.gu, n.v, n.sub_v),
      f AS (SELECT pts.channel, pts.w_plane, pts.pol, pts.u, pts.v, pts.sub_u, pts.sub_v, CAST(sum(r.re * k.re - r.im * k.im) AS BIGINT) AS re, CAST(sum(r.re * k.im + r.im * k.re) AS BIGINT) AS im
            FROM pts JOIN k ON k.p = pts.w_plane AND k.s = pts.sub_u JOIN r ON r.channel = pts.channel AND r.w_plane = pts.w_plane AND r.pol = pts.pol AND r.v = pts.v AND r.sub_v = pts.sub_v AND r.gu = pts.u + k.j
            GROUP BY pts.channel, pts.w_plane, pts.pol, pts.u, pts.v, pts.sub_u, pts.sub_v)
      SELECT z.channel, z.w_slice, z.w_plane, z.pol, z.u, z.v, z.sub_u, z.sub_v, z.wt AS weight, z.re * 10000 - z.wt * f.re AS re, z.im * 10000 - z.wt * f.im AS im
      FROM compressed z JOIN f ON f.channel = z.channel AND f.w_plane = z.w_plane AND f.pol = z.pol AND f.u = z.u AND f.v = z.v AND f.sub_u = z.sub_u AND f.sub_v = z.sub_v""",
    "conv_grid_k3": f"""WITH {QUANT}, {TAPS}, s AS (SELECT channel, w_slice, pol, u, v, CAST(sum(re * wt) AS BIGINT) AS re, CAST(sum(im * wt) AS BIGINT) AS im FROM c GROUP BY channel, w_slice, pol, u, v)
      SELECT channel, w_slice, pol, u + a.j AS u, v + b.j AS v, CAST(sum(re * a.k * b.k) AS BIGINT) AS re, CAST(sum(im * a.k * b.k) AS BIGINT) AS im FROM s CROSS JOIN taps a CROSS JOIN taps b GROUP BY channel, w_slice, pol, u + a.j, v + b.j""",
    "degrid_k3": f"""WITH {CELLS}, {TAPS}, p AS (SELECT DISTINCT channel, pol, u, v FROM c), f AS (SELECT channel, pol, p.u, p.v, p.u + a.j AS gu, p.v + b.j AS gv, a.k * b.k AS k FROM p CROSS JOIN taps a CROSS JOIN taps b)
      SELECT f.channel, f.pol, f.u, f.v, CAST(sum(f.k * g.w) AS BIGINT) AS predicted FROM f JOIN grid g ON g.channel = f.channel AND g.pol = f.pol AND g.u = f.gu AND g.v = f.gv GROUP BY f.channel, f.pol, f.u, f.v""",
    # flux of one direction is summed in cents and each product rounded to 1e-6, so that all sums are over integers
    "predict_direct": f"""WITH {QUANT}, s AS (SELECT p_size * 1e-4 AS l, (p_partkey % 7 - 3) * 1e-4 AS m, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) * 1e-2 AS flux FROM part GROUP BY p_size, p_partkey % 7),
      p AS (SELECT DISTINCT channel, u, v FROM c), d AS (SELECT DISTINCT u, v FROM p), t AS (SELECT d.u, d.v, flux, -6283185307179586e-15 * (l * d.u + m * d.v) AS phase FROM d CROSS JOIN s),
      f AS (SELECT u, v, CAST(sum(CAST(round(flux * cos(phase) * 1e6) AS BIGINT)) AS BIGINT) AS re, CAST(sum(CAST(round(flux * sin(phase) * 1e6) AS BIGINT)) AS BIGINT) AS im FROM t GROUP BY u, v)
      SELECT p.channel, p.u, p.v, floor(re * 1e-3 + 5e-1) / 1e3 AS re, floor(im * 1e-3 + 5e-1) / 1e3 AS im FROM p JOIN f ON f.u = p.u AND f.v = p.v""",
    # along x, then along y
    "dft_grid_to_image": f"""WITH {PIX}, {ALONG_X}
      SELECT img, n.o AS y, a.x, round(sum(c * cos(7853981633974483e-16 * ((n.o - 4) * (a.y - 4))) - s * sin(7853981633974483e-16 * ((n.o - 4) * (a.y - 4)))), 3) + 0e0 AS value FROM a CROSS JOIN n GROUP BY img, n.o, a.x""",
    "dft_image_to_grid": f"""WITH {PIX}, {ALONG_X}
      SELECT img, n.o AS y, a.x, round(sum(c * cos(7853981633974483e-16 * ((n.o - 4) * (a.y - 4))) - s * sin(7853981633974483e-16 * ((n.o - 4) * (a.y - 4)))), 3) + 0e0 AS re,
        round(-sum(s * cos(7853981633974483e-16 * ((n.o - 4) * (a.y - 4))) + c * sin(7853981633974483e-16 * ((n.o - 4) * (a.y - 4)))), 3) + 0e0 AS im FROM a CROSS JOIN n GROUP BY img, n.o, a.x""",
    "fftshift": f"WITH {PIX} SELECT img, (y + 4) % 8 AS y, (x + 4) % 8 AS x, v FROM px",
    "taper_w_correct": f"WITH {PIX}, t AS (SELECT DISTINCT y AS i, 1e0 - 1e-2 * (y - 4) * (y - 4) AS k FROM px) SELECT img, px.y, px.x, round(v / (a.k * b.k) * sqrt(1e0 - 1e-4 * ((px.y - 4) * (px.y - 4) + (px.x - 4) * (px.x - 4))), 6) AS value FROM px JOIN t a ON a.i = px.y JOIN t b ON b.i = px.x",
    "scale_image": f"WITH {PIX} SELECT img, pol, y, x, v * (pol + 2) AS value FROM px",
    "add_image": f"WITH {PIX} SELECT pol, y, x, CAST(sum(v) AS BIGINT) AS value FROM px GROUP BY pol, y, x",
    "apply_beam_cutoff": f"WITH {PIX}, {BEAM} SELECT img, px.y, px.x, CASE WHEN b < 5e-1 THEN 0e0 ELSE round(v / b, 6) END AS value FROM px JOIN beam ON beam.y = px.y AND beam.x = px.x",
    "noise_est": f"WITH {PIX} SELECT img, round(median(abs(v)) * 14826022185056031e-16, 6) AS noise FROM px WHERE y >= 1 AND y < 7 AND x >= 1 AND x < 7 GROUP BY img",
    "rank_count": f"WITH {PIX} SELECT img, CAST(sum(CASE WHEN abs(v) < 1000 THEN 1 ELSE 0 END) AS BIGINT) AS below FROM px GROUP BY img",
    "psf_patch": f"WITH {PIX} SELECT img, 2 * max(abs(y - 4)) + 1 AS height, 2 * max(abs(x - 4)) + 1 AS width FROM px WHERE abs(v) >= 2000 AND abs(y - 4) <= 3 AND abs(x - 4) <= 3 GROUP BY img",
    "tile_peak": f"WITH {PIX}, r AS (SELECT img, CAST(floor(y / 4e0) AS BIGINT) AS tile_y, CAST(floor(x / 4e0) AS BIGINT) AS tile_x, y, x, v, row_number() OVER (PARTITION BY img, CAST(floor(y / 4e0) AS BIGINT), CAST(floor(x / 4e0) AS BIGINT) ORDER BY abs(v) DESC, y, x) AS k FROM px) SELECT img, tile_y, tile_x, y, x, v FROM r WHERE k = 1",
    "find_peak": f"WITH {PIX}, r AS (SELECT img, y, x, v, row_number() OVER (PARTITION BY img ORDER BY abs(v) DESC, y, x) AS k FROM px) SELECT img, y, x, v FROM r WHERE k = 1",
    "metric_sumsq": f"WITH {PIX} SELECT pol, y, x, CAST(sum(v * v) AS BIGINT) AS metric FROM px GROUP BY pol, y, x",
    # what counts is the value behind the primary beam, BEAM's factor; null where nothing stands out
    "find_peak_noise_gated": f"WITH {PIX}, n AS (SELECT img, median(abs(v)) * 14826022185056031e-16 AS noise FROM px GROUP BY img) SELECT px.img, max(CASE WHEN abs(v) * (1e0 / (1e0 + 5e-2 * ((y - 4) * (y - 4) + (x - 4) * (x - 4)))) > 75e-1 * noise THEN abs(v) END) AS peak FROM px JOIN n ON n.img = px.img GROUP BY px.img",
    "clean_subtract_once": f"""WITH {PIX}, r AS (SELECT img, y, x, v, row_number() OVER (PARTITION BY img ORDER BY abs(v) DESC, y, x) AS k FROM px), d AS (SELECT -1 AS d, 1 AS g UNION ALL SELECT 0, 2 UNION ALL SELECT 1, 1),
      s AS (SELECT img, y + a.d AS y, x + b.d AS x, v * a.g * b.g AS take FROM r CROSS JOIN d a CROSS JOIN d b WHERE k = 1) SELECT px.img, px.y, px.x, 40 * px.v - coalesce(s.take, 0) AS residual40 FROM px LEFT JOIN s ON s.img = px.img AND s.y = px.y AND s.x = px.x""",
    "accumulate_components": f"WITH {PIX}, r AS (SELECT img, pol, y, x, v, row_number() OVER (PARTITION BY img ORDER BY abs(v) DESC, y, x) AS k FROM px) SELECT pol, y, x, CAST(sum(v) AS BIGINT) AS flux FROM r WHERE k <= 3 GROUP BY pol, y, x",
    "totals_nansum": f"WITH {PIX} SELECT pol, round(sum(v) / (6283185307179586e-15 * 6e0 / (8e0 * ln(2e0))), 4) AS total FROM px GROUP BY pol",
    "data_min_max": f"WITH {PIX} SELECT img, min(v) AS datamin, max(v) AS datamax FROM px GROUP BY img",
    # behind a beam that leaves NaN outside, statistics and thumbnails go without it
    "nan_statistics": f"""WITH {PIX}, {BEAM}, i AS (SELECT img, px.y, px.x, CASE WHEN b < 5e-1 THEN CAST('NaN' AS DOUBLE) ELSE v / b END AS v FROM px JOIN beam ON beam.y = px.y AND beam.x = px.x)
      SELECT img, round(min(CASE WHEN NOT isnan(v) THEN v END), 6) AS datamin, round(max(CASE WHEN NOT isnan(v) THEN v END), 6) AS datamax, round(sum(CASE WHEN NOT isnan(v) THEN v END) / (6283185307179586e-15 * 6e0 / (8e0 * ln(2e0))), 4) AS total, CAST(sum(CASE WHEN isnan(v) THEN 1 ELSE 0 END) AS BIGINT) AS lost FROM i GROUP BY img""",
    "thumbnail_mean": f"WITH {PIX} SELECT img, CAST(floor(y / 4e0) AS BIGINT) AS y, CAST(floor(x / 4e0) AS BIGINT) AS x, CAST(sum(v) AS DOUBLE) / 16e0 AS mean FROM px GROUP BY img, CAST(floor(y / 4e0) AS BIGINT), CAST(floor(x / 4e0) AS BIGINT)",
    "downsample_blocks": f"WITH {PIX} SELECT img, CAST(floor(y / 2e0) AS BIGINT) AS y, CAST(floor(x / 2e0) AS BIGINT) AS x, CAST(sum(v) AS BIGINT) AS sum4 FROM px GROUP BY img, CAST(floor(y / 2e0) AS BIGINT), CAST(floor(x / 2e0) AS BIGINT)",
    "beam_moments": f"WITH {PIX} SELECT img, CAST(sum(abs(v) * (x - 4) * (x - 4)) AS BIGINT) AS sxx, CAST(sum(abs(v) * (x - 4) * (y - 4)) AS BIGINT) AS sxy, CAST(sum(abs(v) * (y - 4) * (y - 4)) AS BIGINT) AS syy, CAST(sum(abs(v)) AS BIGINT) AS s FROM px GROUP BY img",
    "primary_beam_interp": f"""WITH {PIX}, b AS (SELECT 0 AS r, 1e0 AS volt UNION ALL SELECT 1, 9e-1 UNION ALL SELECT 2, 7e-1 UNION ALL SELECT 3, 4e-1 UNION ALL SELECT 4, 2e-1 UNION ALL SELECT 5, 1e-1 UNION ALL SELECT 6, 5e-2),
      d AS (SELECT r, volt, lead(volt) OVER (ORDER BY r) - volt AS step FROM b), o AS (SELECT DISTINCT y, x, sqrt(CAST((y - 4) * (y - 4) + (x - 4) * (x - 4) AS DOUBLE)) AS r FROM px)
      SELECT o.y, o.x, round((volt + step * (o.r - d.r)) * (volt + step * (o.r - d.r)), 9) AS power FROM o JOIN d ON d.r = CAST(floor(o.r) AS BIGINT) WHERE step IS NOT NULL""",
    "fits_axis_flip": f"WITH {PIX} SELECT img, y, 7 - x AS x, v FROM px",
    "fits_grid_unpivot": f"WITH {QUANT}, s AS (SELECT channel, pol, u, v, CAST(sum(re) AS BIGINT) AS re, CAST(sum(im) AS BIGINT) AS im FROM c GROUP BY channel, pol, u, v) SELECT channel, pol, u, v, part, CASE WHEN part = 0 THEN re ELSE im END AS value FROM s CROSS JOIN (VALUES (0), (1)) p(part)",
    "fits_pol_codes": "WITH p AS (SELECT 1 AS stokes, 1 AS code UNION ALL SELECT 2, 2 UNION ALL SELECT 3, 3 UNION ALL SELECT 4, 4 UNION ALL SELECT 5, -1 UNION ALL SELECT 6, -3 UNION ALL SELECT 7, -4 UNION ALL SELECT 8, -2), d AS (SELECT stokes, code, code - lag(code) OVER (ORDER BY stokes) AS step FROM p WHERE stokes <= 4) SELECT stokes, code, step FROM d",
    # of antennas in one line only the two ends can be farthest from another
    "longest_baseline": """WITH l AS (SELECT s_nationkey * 1e2 AS y, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier GROUP BY s_nationkey)
      SELECT round(max(sqrt(greatest((p.hi - q.lo) * (p.hi - q.lo), (q.hi - p.lo) * (q.hi - p.lo)) + (p.y - q.y) * (p.y - q.y))), 6) AS longest FROM l p JOIN l q ON p.y <= q.y""",
    "all_pairs_uvw": "WITH a AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 1e2 AS y FROM supplier) SELECT PAIRS p.id AS a1, q.id AS a2, round(q.x - p.x, 6) AS u, round(q.y - p.y, 6) AS v FROM a p JOIN a q ON p.id < q.id",
    "fk_lookup_spw": "SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'F'",
    "corrprod_outer_missing": "SELECT n.n_nationkey AS baseline, p.r_regionkey AS pol, count(s.s_suppkey) AS present, CASE WHEN count(s.s_suppkey) = 0 THEN 1 ELSE 0 END AS missing FROM nation n CROSS JOIN region p LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_suppkey % 5 = p.r_regionkey GROUP BY n.n_nationkey, p.r_regionkey",
    "rfi_mask_range_join": "WITH m AS (SELECT 1e5 AS lo, 12e4 AS hi UNION ALL SELECT 2e5, 21e4), c AS (SELECT o_orderkey AS channel, o_totalprice AS freq FROM orders) SELECT channel, freq FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE c.freq >= m.lo AND c.freq <= m.hi)",
    "target_intervals": f"WITH {runs('user_id')} SELECT x AS user_id, min(event_id) - 5e-1 AS start, max(event_id) + 5e-1 AS stop FROM r GROUP BY x, run",
    "time_on_target": "SELECT user_id, count(*) * 4 AS seconds FROM events WHERE event_type = 'click' GROUP BY user_id",
    # halved until shorter than 11 hours of 100 dumps: as often as what whole limits fit in has binary digits
    "split_long_intervals": """WITH i AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY user_id), q AS (SELECT *, CAST(floor((hi - lo) / 11e2) AS BIGINT) AS q FROM i),
      h AS (SELECT user_id, lo, hi, CASE WHEN q = 0 THEN CAST(1 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(length(bin(q)) AS INT) END AS n FROM q)
      SELECT user_id, lo + (hi - lo) * k / CAST(n AS DOUBLE) AS start, lo + (hi - lo) * (k + 1) / CAST(n AS DOUBLE) AS stop FROM h PIECES""",
    "status_left_default": "SELECT o_orderkey, CASE WHEN e.event_id IS NOT NULL THEN e.event_type WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'masked' END AS status FROM orders LEFT JOIN events e ON e.event_id = o_orderkey",
    "status_counts": "SELECT event_type AS status, count(*) AS n FROM events GROUP BY ROLLUP (event_type)",
    "skip_done_antijoin": "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = o.o_orderkey AND e.event_type = 'purchase')",
    "vis_limit": "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 100",
    "block_batches": "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, event_type FROM events) SELECT event_type, CAST(floor((k - 1) / 64e0) AS BIGINT) AS block, min(event_id) AS first_id, count(*) AS n FROM r GROUP BY event_type, CAST(floor((k - 1) / 64e0) AS BIGINT)",
    "channel_batches": "SELECT CAST(floor(o_orderkey / 16e0) AS BIGINT) AS batch, min(o_orderkey) AS first_channel, count(*) AS n FROM orders GROUP BY CAST(floor(o_orderkey / 16e0) AS BIGINT)",
    "sefd_polynomial": "WITH f AS (SELECT o_orderkey, o_totalprice * 1e-5 AS x FROM orders) SELECT o_orderkey, CASE WHEN x >= 2e-1 AND x <= 3e0 THEN round(sqrt(((3e0 + x + 2e0 * x * x) * (3e0 + x + 2e0 * x * x) + (1e0 + x) * (1e0 + x)) / 2e0), 9) END AS sefd FROM f",
    "thermal_noise": "WITH f AS (SELECT o_orderkey, 4e2 + o_totalprice * 1e-4 AS sefd FROM orders) SELECT o_orderkey, round(sefd / sqrt(2e0 * 64 * 63 * 36e2 * 26123e0), 12) AS noise FROM f",
    "sky_flux_density": "SELECT p_partkey, CASE WHEN p_size >= 5 THEN round(p_retailprice * power(1e1, -5e-1 * log10(p_size * 1e0) + 1e-1 * log10(p_size * 1e0) * log10(p_size * 1e0)), 6) ELSE 0e0 END AS flux FROM part",
    "sky_lmn": "WITH s AS (SELECT p_partkey, p_size * 1e-2 AS ra, (p_partkey % 90 - 45) * 1e-2 AS de FROM part) SELECT p_partkey, round(cos(de) * sin(ra - 2e-1), 9) AS l, round(sin(de) * cos(1e-1) - cos(de) * sin(1e-1) * cos(ra - 2e-1), 9) AS m, round(sin(de) * sin(1e-1) + cos(de) * cos(1e-1) * cos(ra - 2e-1), 9) AS n FROM s",
    "flamegraph_exclusive": "WITH s AS (SELECT event_type AS stack, CAST(round(value * 100) AS BIGINT) AS t FROM events UNION ALL SELECT concat('user;', event_type), CAST(round(value * 40) AS BIGINT) FROM events UNION ALL SELECT event_type, -CAST(round(value * 40) AS BIGINT) FROM events) SELECT stack, CAST(sum(t) AS BIGINT) AS exclusive FROM s GROUP BY stack",
    "stats_pivot": "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS click, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS view_, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchase FROM events GROUP BY user_id",
    "mean_position_time": "SELECT count(DISTINCT ts) AS n_times, round(avg(s.x), 6) AS x FROM events CROSS JOIN (SELECT avg(s_acctbal) AS x FROM supplier) s",
    "distinct_inverse": f"""WITH d AS (SELECT DISTINCT user_id FROM events), k AS (SELECT user_id, CAST(floor(user_id / 64e0) AS BIGINT) AS blk FROM d), t AS (SELECT blk, count(*) AS c FROM k GROUP BY blk), {sum_before("t", "blk", "c", "o")},
      u AS (SELECT user_id, CAST(o.base + row_number() OVER (PARTITION BY k.blk ORDER BY user_id) AS BIGINT) AS place FROM k JOIN o ON o.blk = k.blk) SELECT event_id, place FROM events JOIN u ON u.user_id = events.user_id""",
    "equal_diameters": "SELECT CASE WHEN min(s_nationkey) = max(s_nationkey) THEN 1 ELSE 0 END AS equal, count(DISTINCT s_nationkey) AS n FROM supplier",
    "equal_spacing": f"""WITH b AS (SELECT event_id, CAST(floor(event_id / {BLOCK}e0) AS BIGINT) AS blk FROM events), ends AS (SELECT blk, min(event_id) AS lo, max(event_id) AS hi FROM b GROUP BY blk), {before_each("ends", "blk", "hi", "prev", "hi")},
      d AS (SELECT lead(event_id) OVER (PARTITION BY blk ORDER BY event_id) - event_id AS step FROM b UNION ALL SELECT e.lo - p.hi FROM ends e JOIN prev p ON p.blk = e.blk) SELECT min(step) AS least, max(step) AS most FROM d""",
    "sort_by_baseline": f"WITH {VIS} SELECT ant1 * 16 + ant2 AS baseline, l_orderkey, pol, re FROM vis WHERE ant1 <> ant2 ORDER BY baseline, l_orderkey, pol, re",
    "target_priority": "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 2 END, c_custkey) AS k FROM customer) SELECT c_custkey, c_mktsegment FROM r WHERE k = 1",
    "duration_format": "SELECT event_id, concat(CAST(CAST(floor(event_id / 36e2) AS BIGINT) AS VARCHAR(20)), ':', lpad(CAST(CAST(floor(event_id / 6e1) AS BIGINT) % 60 AS VARCHAR(20)), 2, '0'), ':', lpad(CAST(event_id % 60 AS VARCHAR(20)), 2, '0')) AS duration FROM events",
    "corr_product_split": "SELECT s_suppkey, substr(s_name, 1, length(s_name) - 1) AS antenna, right(s_name, 1) AS feed FROM supplier",
}
#: Where Spark runs another plan with the same result.
SPARK_SQL = {"degrid_kernel": degrid_text()}


def text(name: str, dialect: str) -> str:
    spark = dialect == "spark"
    t = (SPARK_SQL.get(name, SQL[name]) if spark else SQL[name]).replace("WITH PIXELS", "WITH " + (SPARK_PIX if spark else DUCK_PIX)).replace("h PIECES", SPARK_PIECES if spark else DUCK_PIECES)
    t = re.sub(r"MARKED (\w+)", lambda m: marked(m[1]) + ("," if spark else f", {BLOCKS},"), t)
    t = t.replace("SELECT PAIRS ", "SELECT /*+ SHUFFLE_REPLICATE_NL(p, q) */ " if spark else "SELECT ")
    return t.replace("WITH COMPRESSED, ", "WITH " if spark else f"WITH {QUANT}, {COMPRESSED}, ")


def in_blocks(spark: SparkSession, sf_dir: str, name: str, near: str, order: list[str]) -> None:
    """The view ``name`` dealt into blocks of some BLOCK rows: a task of its product with itself meets one pair of blocks and holds one of them.

    A block is a range of ``near``, so a task has few differences of it, and is in ``order``: columns of its
    pairs have few values in long runs, which Parquet keeps in few bits. A sort below a join would be left out
    of the plan, so the blocks are written once.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    blocks = rows.repartitionByRange(max(1, math.ceil(rows.count() / BLOCK)), near, *order)
    checkpoint(blocks.sortWithinPartitions(*order)).createOrReplaceTempView(name)


def query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text(name, "spark"))])
        if "SELECT PAIRS" in SQL[name]:
            in_blocks(spark, sf_dir, "supplier", "s_acctbal", ["s_nationkey", "s_suppkey"])
        if "WITH COMPRESSED" in SQL[name]:
            register(spark, sf_dir, ["lineitem"])
            checkpoint(spark.sql(f"WITH {QUANT}, {COMPRESSED} SELECT * FROM compressed")).createOrReplaceTempView("compressed")
        if value := re.search(r"MARKED (\w+)", SQL[name]):
            checkpoint(spark.sql(f"WITH {marked(value[1])}, {BLOCKS} SELECT * FROM blocks")).createOrReplaceTempView("blocks")
        return spark.sql(text(name, "spark").replace("TASKS", spark.conf.get("spark.sql.shuffle.partitions")))

    return run


QUERIES = {name: query(name) for name in SQL}
ORACLE_SQL = {name: text(name, "duckdb") for name in SQL}
