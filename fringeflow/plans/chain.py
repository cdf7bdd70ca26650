"""From samples to restored images: one plan for all channels, with major cycles as a driver loop.

Records, grids and predictions are DataFrames keyed by channel. Records are compressed once and stored in buckets of (channel, w slice, band of grid rows); weights are
in them, so each major cycle reads, grids and subtracts them where they lie. A layer is transformed on its own and layers are added one at a time; only the images of
one channel meet in one group, whose size the channel's parameters fix, and of its PSF only the patch.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import taper, w_kernel
from ..operators import cleaning, polarize, spill
from ..operators.cleaning import CleanParameters
from ..operators.imaging import convolve, fit_beam, grid_to_image, image_to_grid
from ..operators.preprocess import KEY, compress, quantize
from ..operators.primary_beam import correct, power_grid
from ..sources.products import Writer, remaining
from ..sources.sky import direction_cosines, flux_density

CELL = ["channel", "pol", "u", "v"]
#: Parameters of each channel, a row each; lengths in metres, ``pixel_size`` the sine of an angle.
PARAMETERS = "channel long, wavelength double, pixels int, pixel_size double, cell_size double, w_slices int, w_planes int, max_w double"
#: Kernel: anti-aliasing width, taps, sub-cells a cell, times its transform is oversampled.
WIDTH, TAPS, OVERSAMPLE, IMAGE_OVERSAMPLE = 7, 8, 8, 4
#: Bytes of kernels, and sources of a sky model, that are sent to all tasks at once.
SENT_BYTES, SENT_SOURCES = 1 << 26, 1 << 14


def parameters(spark: SparkSession, channels: Iterable[dict], max_w: float) -> DataFrame:
    """A row of PARAMETERS for each dict (channel and what ``functions.params.channel_parameters`` gives)."""
    names = [c.split()[0] for c in PARAMETERS.split(", ")]
    return spark.createDataFrame([tuple({**c, "max_w": float(max_w)}[n] for n in names) for c in channels], PARAMETERS)


def _slice_step(p) -> float:
    """Wavelengths between the centres of w slices."""
    return p.max_w / p.wavelength / (p.w_slices - 0.5)


def kernels(params: DataFrame, oversample: int = OVERSAMPLE, taps: int = TAPS) -> DataFrame:
    """(channel, p, s, j, kre, kim): the kernel of a channel's w plane and sub-cell at tap j."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch.itertuples():
                for p in range(c.w_planes):
                    k = w_kernel(c.cell_size / c.wavelength, (p - c.w_planes / 2 + 0.5) * _slice_step(c) / c.w_planes, WIDTH, oversample, taps, IMAGE_OVERSAMPLE)
                    s, j = (x.ravel() for x in np.indices(k.shape))
                    yield pd.DataFrame({"channel": c.channel, "p": p, "s": s, "j": j + 1 - taps // 2, "kre": k.real.ravel(), "kim": k.imag.ravel()})

    made = params.mapInPandas(rows, "channel long, p int, s int, j int, kre double, kim double")
    size = params.agg(F.sum(F.col("w_planes") * F.lit(oversample * taps * 40))).first()[0] or 0
    return F.broadcast(made) if size <= SENT_BYTES else made


def layer(pixels: int, pixel_size: float, w: float, oversample: int = OVERSAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """What a point of the image is multiplied by on its way to the layer at w, and n."""
    t = taper(pixels, WIDTH, oversample)
    l = (np.arange(pixels) - pixels // 2) * pixel_size  # noqa: E741
    r2 = l[:, None] ** 2 + l**2
    n = np.sqrt(np.maximum(1 - r2, 0))
    return np.exp(-2j * np.pi * w * (-r2 / (1 + n))) / (t[:, None] * t), n


def preprocess(samples: DataFrame, params: DataFrame, matrix: polarize.Matrix, oversample: int = OVERSAMPLE, taps: int = TAPS) -> DataFrame:
    """Compressed records of samples (row_id, channel, u, v, w in metres; arrays weight, re, im), turned by the Mueller ``matrix``.

    A sample off its channel's grid, kernel included, raises; one beyond ``max_w`` is held in the last w plane. Samples of channels without parameters go.
    """
    # samples are summed where they are read; dealt by channel, a task would hold all of one
    d = polarize.unrolled(polarize.apply(samples, matrix)).where(F.col("weight") > 0).join(F.broadcast(params), "channel")
    edge = (F.col("pixels") / 2 - taps) * F.col("cell_size")
    on_grid = lambda c: F.when(F.abs(c) < edge, F.col(c)).otherwise(F.raise_error(F.format_string("%s of %f m is off the grid of channel %d", F.lit(c), F.col(c), F.col("channel"))).cast("double"))
    d = d.withColumn("u", on_grid("u")).withColumn("v", on_grid("v"))
    return compress(quantize(d, oversample))


def weigh(records: DataFrame, kind: str = "natural", robustness: float = 0.0) -> DataFrame:
    """``records`` with their cell's ``density``: 1, or 1 / W, or 1 / (a W + b), W the cell's weight; a follows from the robustness and polarization 0."""
    if kind == "natural":
        return records.withColumn("density", F.lit(1.0))
    cells = records.groupBy(*CELL).agg(F.sum("weight").alias("cell_weight"))
    if kind == "uniform":
        return records.join(cells.withColumn("density", 1 / F.col("cell_weight")).drop("cell_weight"), CELL)
    if kind != "robust":
        raise ValueError(f"no weights of kind {kind!r}")
    mean = cells.where("pol = 0").groupBy("channel").agg((F.sum(F.col("cell_weight") ** 2) / F.sum("cell_weight")).alias("mean_weight"))
    a = (5 * 10**-robustness) ** 2 / F.col("mean_weight")
    return records.join(cells.join(F.broadcast(mean), "channel").select(*CELL, (1 / (a * F.col("cell_weight") + 1)).alias("density")), CELL)


def weights_noise(weighted: DataFrame, kind: str) -> DataFrame:
    """(channel, weights_noise, normalized_noise): thermal noise of the image by polarization 0, and times that of natural weights; null and 1 for those."""
    sums = weighted.where("pol = 0").groupBy("channel").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("density")).alias("dw"), F.sum(F.col("weight") * F.col("density") ** 2).alias("ddw"))
    noise = F.sqrt("ddw") / F.col("dw")
    natural = kind == "natural"
    return sums.select("channel", (F.lit(None).cast("double") if natural else noise).alias("weights_noise"), (F.lit(1.0) if natural else noise * F.sqrt("w")).alias("normalized_noise"))


def grid(weighted: DataFrame, k: DataFrame) -> DataFrame:
    """Cell sums (channel, pol, w_slice, u, v, re, im) of value x density by the conjugate kernel, along u within a band's rows and then along v."""
    turn = [F.sum(F.col("re") * F.col("kre") + F.col("im") * F.col("kim")).alias("re"), F.sum(F.col("im") * F.col("kre") - F.col("re") * F.col("kim")).alias("im")]
    d = weighted.select(*spill.PART, "pol", "w_plane", "u", "v", "sub_u", "sub_v", *[(F.col(c) * F.col("density")).alias(c) for c in ("re", "im")])
    tap = lambda sub: k.withColumnsRenamed({"p": "w_plane", "s": sub})
    half = d.join(tap("sub_u"), ["channel", "w_plane", "sub_u"]).groupBy(*spill.PART, "pol", "w_plane", (F.col("u") + F.col("j")).alias("u"), "v", "sub_v").agg(*turn)
    return half.join(tap("sub_v"), ["channel", "w_plane", "sub_v"]).groupBy("channel", "pol", "w_slice", "u", (F.col("v") + F.col("j")).alias("v")).agg(*turn)


def to_images(cells: DataFrame, params: DataFrame, oversample: int = OVERSAMPLE) -> DataFrame:
    """(channel, pol, pixels, pixels_a_side, pixel_size): each layer transformed on its own, then those of a channel and polarization added one at a time, times n."""

    def image(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = next(rows.itertuples(index=False))
        g = np.zeros((p.pixels, p.pixels), complex)
        g[rows.v.to_numpy(int) + p.pixels // 2, rows.u.to_numpy(int) + p.pixels // 2] = rows.re.to_numpy() + 1j * rows.im.to_numpy()
        turn, n = layer(p.pixels, p.pixel_size, key[2] * _slice_step(p), oversample)
        return pd.DataFrame({"channel": [key[0]], "pol": [key[1]], "w_slice": [key[2]], "image": [((grid_to_image(g) * np.conj(turn)).real * n).ravel()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for batch in batches:
            for r in batch.itertuples():
                if (r.channel, r.pol) == now:
                    total = total + r.image
                    continue
                if now:
                    yield pd.DataFrame({"channel": [now[0]], "pol": [now[1]], "image": [total]})
                now, total = (r.channel, r.pol), np.array(r.image)
        if now:
            yield pd.DataFrame({"channel": [now[0]], "pol": [now[1]], "image": [total]})

    layers = cells.join(params, "channel").groupBy("channel", "pol", "w_slice").applyInPandas(image, "channel long, pol long, w_slice long, image array<double>")
    return layers.repartition("channel", "pol").sortWithinPartitions("channel", "pol", "w_slice").mapInPandas(add, "channel long, pol long, image array<double>")


def to_grid(models: DataFrame, slices: DataFrame, params: DataFrame, oversample: int = OVERSAMPLE) -> DataFrame:
    """Cells (channel, pol, w_slice, u, v, mre, mim) of model images divided by n, for the ``slices`` (channel, w_slice) in use."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                v, u = (x.ravel() - r.pixels // 2 for x in np.indices((r.pixels, r.pixels)))
                turn, n = layer(r.pixels, r.pixel_size, r.w_slice * _slice_step(r), oversample)
                g = image_to_grid(np.divide(np.reshape(r.model, n.shape), n, out=np.zeros(n.shape), where=n > 0) * turn).ravel()
                yield pd.DataFrame({"channel": r.channel, "pol": r.pol, "w_slice": r.w_slice, "u": u, "v": v, "mre": g.real, "mim": g.imag})

    return models.select("channel", "pol", "model").join(slices, "channel").join(params, "channel").mapInPandas(cells, "channel long, pol long, w_slice long, u long, v long, mre double, mim double")


def residual(weighted: DataFrame, cells: DataFrame, k: DataFrame, taps: int = TAPS) -> DataFrame:
    """``weighted`` less weight x the model's prediction at each record: of the model's cells only the columns that records need are summed along v, then along u.

    All joins are within a part of the store; the model's rows are dealt to the bands that reach them, the records stay.
    """
    times = [F.sum(F.col("mre") * F.col("kre") - F.col("mim") * F.col("kim")).alias("mre"), F.sum(F.col("mre") * F.col("kim") + F.col("mim") * F.col("kre")).alias("mim")]
    low, high = 1 - taps // 2, taps - taps // 2
    bands = F.array_distinct(F.array(*[F.floor((F.col("v") - j) / spill.BAND).cast("int") for j in (low, high)]))
    dealt = cells.withColumn("band", F.explode(bands))
    at = weighted.select(*spill.PART, "pol", "w_plane", "u", F.col("v").alias("v0"), "sub_u", "sub_v").distinct()
    row = [*spill.PART, "pol", "w_plane", "sub_v", "v0"]
    tap = lambda sub: k.withColumnsRenamed({"p": "w_plane", "s": sub})
    near = at.join(tap("sub_u"), ["channel", "w_plane", "sub_u"]).withColumn("gu", F.col("u") + F.col("j")).drop("j")
    need = near.select(*row, "gu").distinct().join(tap("sub_v"), ["channel", "w_plane", "sub_v"])
    need = need.select(*row, F.col("gu").alias("u"), (F.col("v0") + F.col("j")).alias("v"), "kre", "kim")
    summed = need.join(dealt, [*spill.PART, "pol", "u", "v"]).groupBy(*row, F.col("u").alias("gu")).agg(*times)
    got = near.join(summed, [*row, "gu"]).groupBy(*row, "sub_u", "u").agg(*times).withColumnRenamed("v0", "v")
    less = lambda c: (F.col(c) - F.col("weight") * F.coalesce("m" + c, F.lit(0.0))).alias(c)
    return weighted.join(got, [*spill.PART, "pol", "w_plane", "sub_v", "v", "sub_u", "u"], "left").select(*KEY, "band", "pol", "weight", less("re"), less("im"), "density")


def subtract_sky(records: DataFrame, sources: DataFrame, params: DataFrame, centre: tuple[float, float], oversample: int = OVERSAMPLE) -> DataFrame:
    """``records`` less weight x what point ``sources`` (ra, dec, min_hz, max_hz, coefficients, stokes) give at the middle of each record's sub-cell and w plane.

    Polarizations of records are Stokes I, Q, U, V. Sources below the horizon and without flux add nothing; they are sent in blocks of SENT_SOURCES. The flux is
    tapered as the sub-cell's mean tapers it.
    """
    l, m, less = direction_cosines(*centre)  # noqa: E741
    columns = ["min_hz", "max_hz", "coefficients", "stokes", "ra", "dec"]
    seen = sources.where(F.cos(F.col("dec")) * math.cos(centre[1]) * F.cos(F.col("ra") - centre[0]) + F.sin("dec") * math.sin(centre[1]) > 0)
    spark = records.sparkSession
    channels = params.select("channel", (299792458.0 / F.col("wavelength")).alias("f"))
    flux = seen.select(*columns, l.alias("l"), m.alias("m"), less.alias("n1")).crossJoin(F.broadcast(channels)).select("channel", "l", "m", "n1", flux_density(F.col("f")).alias("flux")).where("exists(flux, x -> x <> 0)")
    order = ["channel", "l", "m", "n1"]
    numbered = spill.checkpoint(flux.orderBy(*order).withColumn("block", F.floor(F.monotonically_increasing_id() % F.lit(1 << 33) / SENT_SOURCES)).withColumn("part", F.spark_partition_id()))
    kept = params.select("channel", "wavelength", "cell_size", "pixels", "pixel_size", "w_slices", "w_planes", "max_w")
    out = records
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    names = records.columns
    for b in numbered.select("part", "block").distinct().collect():
        some = numbered.where((F.col("part") == b["part"]) & (F.col("block") == b["block"])).select(*order, "flux").toPandas()
        by_channel = {int(c): (x[["l", "m", "n1"]].to_numpy(), np.stack(x.flux.to_numpy())) for c, x in some.groupby("channel")}
        sent = spark.sparkContext.broadcast(by_channel)

        def subtract(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                re, im = batch.re.to_numpy(float).copy(), batch.im.to_numpy(float).copy()
                for channel, rows in batch.groupby("channel").indices.items():
                    if channel not in sent.value:
                        continue
                    lmn, f = sent.value[channel]
                    r = batch.iloc[rows]
                    p = next(r.itertuples(index=False))
                    cell = p.cell_size / p.wavelength
                    at = [(r[c].to_numpy() * oversample + r["sub_" + c].to_numpy() + 0.5) * (cell / oversample) for c in "uv"]
                    at.append((r.w_slice.to_numpy() + (r.w_plane.to_numpy() + 0.5 - p.w_planes / 2) / p.w_planes) * _slice_step(p))
                    size = p.pixels * p.pixel_size * oversample
                    mean = np.sinc(lmn[:, 0] / size) * np.sinc(lmn[:, 1] / size)
                    for k in range(0, len(rows), 1024):
                        turns = np.stack(at, 1)[k : k + 1024] @ lmn.T
                        wave = np.exp(-2j * np.pi * (turns - np.rint(turns)))
                        value = (wave * (f.T[r.pol.to_numpy()[k : k + 1024]] * mean)).sum(axis=1) * r.weight.to_numpy()[k : k + 1024]
                        re[rows[k : k + 1024]] -= value.real
                        im[rows[k : k + 1024]] -= value.imag
                yield batch.assign(re=re, im=im)[names]

        out = out.join(F.broadcast(kept), "channel").mapInPandas(subtract, schema)
    return out


PSF = "channel long, scale array<double>, patch array<double>, height int, width int, major double, minor double, angle double"


def point_spread(psf: DataFrame, params: DataFrame, clean: CleanParameters) -> DataFrame:
    """Of a channel's PSFs (channel, pol, image) only: 1 / peak of each polarization, the patch that CLEAN subtracts, and the beam fitted to that of the first.
    Channels of which a PSF has no peak have no row: they have no usable data."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pol")
        size = int(rows.pixels.iloc[0])
        psf = np.stack([np.reshape(x, (size, size)) for x in rows.image])
        peak = psf[:, size // 2, size // 2]
        columns = [c.split()[0] for c in PSF.split(", ")]
        if (peak == 0).any():
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        psf = psf / peak[:, None, None]
        h, w = cleaning.psf_patch(psf, clean.patch_threshold, clean.patch_limit)
        patch = cleaning.central(psf, (h, w))
        values = [rows.channel.iloc[0], 1 / peak, patch.ravel(), h, w, *fit_beam(patch[0])]
        return pd.DataFrame({c: [v] for c, v in zip(columns, values)})

    return psf.join(params.select("channel", "pixels"), "channel").groupBy("channel").applyInPandas(step, PSF)


STATE = "channel long, pol long, model array<double>, residual array<double>, noise double, cycles long, majors int, over boolean"


def minor_cycles(images: DataFrame, clean: CleanParameters) -> DataFrame:
    """A channel's images (channel, pol, image, model, minors, majors, pixels and what ``point_spread`` gives) cleaned together for one major cycle."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pol")
        r, size = rows.iloc[0], int(rows.pixels.iloc[0])
        stack = lambda c: np.stack([np.reshape(x, (size, size)) if x is not None else np.zeros((size, size)) for x in rows[c]])
        image, model = stack("image") * np.asarray(r.scale)[:, None, None], stack("model")
        patch = np.reshape(r.patch, (len(rows), int(r.height), int(r.width)))
        done = cleaning.major_cycle(image, model, patch, clean)
        return pd.DataFrame({"channel": rows.channel, "pol": rows.pol, "model": [x.ravel() for x in model], "residual": [x.ravel() for x in image], "noise": cleaning.noise(image, clean.border), "cycles": rows.cycles + done["cycles"], "majors": rows.majors + 1, "over": done["over"]})

    return images.groupBy("channel").applyInPandas(step, STATE)


RESULT = (
    "channel long, pol long, model array<double>, residual array<double>, restored array<double>, primary_beam array<double>, noise double, peak double, total double, cycles long, "
    "majors int, major double, minor double, angle double, patch_height int, patch_width int"
)
#: Products that are kept on demand.
MORE = ("psf", "dirty", "weights", "grid")


def finish(state: DataFrame, spread: DataFrame, params: DataFrame, beam: DataFrame | None = None, step: float = 1.0, cutoff: float = 0.1) -> DataFrame:
    """Restored images: model and residual divided by the primary ``beam`` (channel, voltages) where it is above ``cutoff`` (beyond, the model is 0 and the residual
    NaN), the model convolved with the fitted beam (as it is where none fits), and the residual added; with peak and total flux."""
    beams = beam if beam is not None else params.select("channel", F.lit(None).cast("array<double>").alias("voltages"))
    corrected = beam is not None

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pol")
        r, size = rows.iloc[0], int(rows.pixels.iloc[0])
        model, left = (np.stack([np.reshape(x, (size, size)) for x in rows[c]]) for c in ("model", "residual"))
        pb = power_grid(r.voltages, step, size, r.pixel_size) if corrected else np.ones((size, size))
        if corrected:
            model, left = correct(model, pb, cutoff, 0.0), correct(left, pb, cutoff, math.nan)
        fits = math.isfinite(r.major)
        restored = left + (np.stack([convolve(m, r.major, r.minor, r.angle) for m in model]) if fits else model)
        peak = cleaning.find_peak(restored, pb, r.noise)
        total = cleaning.totals(restored, r.major, r.minor) if fits else np.full(len(rows), math.nan)
        columns = {"channel": rows.channel, "pol": rows.pol, "model": [x.ravel() for x in model], "residual": [x.ravel() for x in left], "restored": [x.ravel() for x in restored], "primary_beam": [pb.ravel()] * len(rows)}
        columns |= {"noise": rows.noise, "peak": peak, "total": total, "cycles": rows.cycles, "majors": rows.majors, "major": r.major, "minor": r.minor, "angle": r.angle, "patch_height": r.height, "patch_width": r.width}
        return pd.DataFrame(columns)

    together = state.join(spread.drop("scale", "patch"), "channel").join(params.select("channel", "pixels", "pixel_size"), "channel").join(beams, "channel", "left")
    # pandas hands NaN over as null
    nan = {c: F.transform(c, lambda x: F.coalesce(x, F.lit(math.nan))) for c in ("residual", "restored", "primary_beam")}
    return together.groupBy("channel").applyInPandas(one, RESULT).withColumns(nan)


def dense(cells: DataFrame, params: DataFrame, *values: str) -> DataFrame:
    """(channel, pol, pixels): cells (channel, pol, u, v, values) as one array a channel and polarization, 0 where there is none; several values in turn."""

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows.pixels.iloc[0])
        out = np.zeros((size, size, len(values)))
        out[rows.v.to_numpy(int) + size // 2, rows.u.to_numpy(int) + size // 2] = rows[list(values)].to_numpy()
        return pd.DataFrame({"channel": [key[0]], "pol": [key[1]], "image": [out.ravel()]})

    return cells.select("channel", "pol", "u", "v", *values).join(params.select("channel", "pixels"), "channel").groupBy("channel", "pol").applyInPandas(fill, "channel long, pol long, image array<double>")


def image_channels(
    samples: DataFrame, params: DataFrame, matrix: polarize.Matrix, weights: str = "natural", robustness: float = 0.0, majors: int = 2, clean: CleanParameters = CleanParameters(),
    sky: DataFrame | None = None, centre: tuple[float, float] = (0.0, 0.0), beam: DataFrame | None = None, beam_step: float = 1.0, cutoff: float = 0.1,
    keep: tuple[str, ...] = (), store: type[spill.Store] = spill.TableStore,
) -> DataFrame:
    """Images of all channels of ``params``: a row (channel, pol) with RESULT's columns, weights_noise, normalized_noise, compressed_vis, and products to ``keep``, of
    MORE: psf and dirty images with a unit peak of the PSF, weights (density of each cell), grid (of the last w slice; real and imaginary part in turn).

    Samples are turned by ``matrix``, compressed, weighed and stored; sources of ``sky`` are subtracted before anything is imaged. Then up to ``majors`` cycles: grid
    and transform, minor cycles, and the model taken from the records in between; a channel whose peak is at its threshold goes no further. Channels without samples
    and channels without a peak of the PSF have no row.
    """
    if unknown := set(keep) - set(MORE):
        raise ValueError(f"no products named {sorted(unknown)}")
    spark = samples.sparkSession
    records = weigh(preprocess(samples, params, matrix), weights, robustness)
    if sky is not None:
        records = subtract_sky(records, sky, params, centre)
    k = kernels(params)
    with store(records) as kept, spill.in_place(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(_rows_a_batch(params))):
        stored = kept.records()
        statistics = spill.checkpoint(weights_noise(stored, weights).join(stored.groupBy("channel").agg(F.count("*").alias("compressed_vis")), "channel"))
        slices = spill.checkpoint(stored.select("channel", "w_slice").distinct())
        ones = stored.withColumns({"re": F.col("weight"), "im": F.lit(0.0)})
        psf = to_images(grid(ones, k), params)
        psf = spill.checkpoint(psf) if "psf" in keep else psf
        spread = spill.checkpoint(point_spread(psf, params, clean))
        scaled = lambda d, name: d.join(spread.select("channel", "scale"), "channel").select("channel", "pol", F.transform("image", lambda x: x * F.get("scale", F.col("pol").cast("int"))).alias(name))
        more = {"psf": lambda: scaled(psf, "psf"), "weights": lambda: dense(stored.select(*CELL, "density").distinct(), params, "density").withColumnRenamed("image", "weights")}
        state, finished, left = None, None, stored
        for cycle in range(majors):
            cells = grid(left, k)
            dirty = to_images(cells, params)
            if not cycle and set(keep) & {"dirty", "grid"}:
                cells = spill.checkpoint(cells)
                first = dirty = spill.checkpoint(to_images(cells, params))
                top = cells.groupBy("channel").agg(F.max("w_slice").alias("w_slice"))
                more |= {"dirty": lambda d=first: scaled(d, "dirty"), "grid": lambda c=cells, t=top: dense(c.join(t, ["channel", "w_slice"]), params, "re", "im").withColumnRenamed("image", "grid")}
            if state is None:
                together = dirty.withColumns({"model": F.lit(None).cast("array<double>"), "cycles": F.lit(0).cast("long"), "majors": F.lit(0)})
            else:
                together = dirty.join(state.select("channel", "pol", "model", "cycles", "majors"), ["channel", "pol"])
            together = together.join(spread, "channel").join(params.select("channel", "pixels"), "channel")
            new = spill.checkpoint(minor_cycles(together, clean))
            last = cycle == majors - 1
            ended = new if last else new.where("over")
            finished = ended if finished is None else finished.unionByName(ended)
            state = new.where("not over")
            if last or not state.limit(1).count():
                break
            live = state.select("channel").distinct()
            left = residual(stored.join(F.broadcast(live), "channel", "left_semi"), to_grid(state, slices, params), k)
        out = None
        if finished is not None:
            made = finish(finished, spread, params, beam, beam_step, cutoff).join(statistics, "channel")
            for product in keep:
                made = made.join(more[product](), ["channel", "pol"], "left")
            out = spill.checkpoint(made)
    return out if out is not None else spark.createDataFrame([], RESULT)


def _rows_a_batch(params: DataFrame) -> int:
    """Rows of images that a Python worker holds at once: some 64 MB."""
    most = params.agg(F.max("pixels")).first()[0] or 1
    return max(1, (1 << 26) // (16 * most * most))


def run(samples: DataFrame, params: DataFrame, matrix: polarize.Matrix, writer: Writer, enabled: DataFrame | None = None, batch: int = 16, **imaging) -> None:
    """Image the channels of ``params`` that ``writer`` hasn't finished and that are ``enabled`` (channel, enabled), ``batch`` channels at a time; a run that stops goes
    on after the last batch that was written. Channels without usable data are told to the writer as skipped; masked ones get no status."""
    todo = remaining(params, writer)
    if enabled is not None:
        todo = todo.join(enabled.where("enabled"), "channel", "left_semi")
    ids = sorted(r["channel"] for r in todo.select("channel").collect())  # a row a channel
    for k in range(0, len(ids), batch):
        chosen = F.col("channel").isin(ids[k : k + batch])
        some = params.where(chosen)
        images = image_channels(samples.where(chosen), some, matrix, keep=tuple(p for p in MORE if writer.needs(p)), **imaging)
        writer.write(images, some)
        writer.statistics(images)
        writer.skip(some.select("channel").join(images.select("channel").distinct(), "channel", "left_anti"))


def table_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples of two polarizations from the whole of lineitem, and the parameters of four channels."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    weight = F.when(F.col("l_returnflag") == "A", 0.0).otherwise(F.lit(1.0) + F.col("l_linenumber"))
    re, im = (F.col("l_extendedprice") / 10000).cast("double"), (F.col("l_quantity") / 10).cast("double")
    samples = d.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), (F.col("l_suppkey") % 4).cast("long").alias("channel"),
        ((F.col("l_quantity") - 25.5) * 12).cast("double").alias("u"), ((F.col("l_extendedprice") / 1000 - 40) * 7).cast("double").alias("v"), (F.col("l_discount") * 100).cast("double").alias("w"),
        F.array(re, im).alias("re"), F.array(im, -re).alias("im"), F.array(weight, weight + 1).alias("weight"),
    )
    lower = samples.withColumn("weight", F.when(F.col("weight")[0] == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.col("weight")))
    pixels, size = 64, 5e-4
    channels = [{"channel": c, "wavelength": 1 + c * 0.01, "pixels": pixels, "pixel_size": size, "cell_size": (1 + c * 0.01) / (pixels * size), "w_slices": 2, "w_planes": 4} for c in range(4)]
    return lower, parameters(spark, channels, 12.0)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = image_channels(*table_samples(spark, sf_dir), polarize.matrix(np.eye(2)), "robust", clean=CleanParameters(minor=200))
    round6 = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(c)
    return got.select("channel", "pol", "cycles", round6("restored"), round6("model"), *[F.round(c, 6).alias(c) for c in ("noise", "peak", "total", "normalized_noise")], F.round("major", 4).alias("major"), F.round("minor", 4).alias("minor"), "compressed_vis")


QUERIES = {"image_channels": _query}
