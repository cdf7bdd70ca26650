"""FITS files as a Spark sink: ``df.write.format("fits")`` writes a file for each channel and product, and moves files to their places when the job commits."""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BLOCK = 2880
#: Codes of the polarization axis.
CODES = {"I": 1, "Q": 2, "U": 3, "V": 4, "RR": -1, "LL": -2, "RL": -3, "LR": -4, "YY": -5, "XX": -6, "YX": -7, "XY": -8}
THUMBNAIL = 512


def _card(key: str, value) -> bytes:
    shown = ("T" if value else "F") if isinstance(value, bool) else f"'{value:<8}'" if isinstance(value, str) else repr(value) if isinstance(value, int) else f"{value:.15G}"
    if isinstance(value, float) and "." not in shown and "E" not in shown:
        shown += ".0"
    return (f"{key:<8}= {shown:<20}" if isinstance(value, str) else f"{key:<8}= {shown:>20}").ljust(80)[:80].encode("ascii")


def polarization_axis(pols: list[str], axis: int) -> tuple[dict, list[int]]:
    """Header of the polarization axis, and the order that makes its codes a linear sequence; ValueError where none does."""
    codes = [CODES[p] for p in pols]
    order = sorted(range(len(pols)), key=lambda i: abs(codes[i]))
    steps = {b - a for a, b in zip(sorted(codes, key=abs), sorted(codes, key=abs)[1:])}
    if len(steps) > 1:
        raise ValueError(f"polarizations {pols} are no linear sequence of FITS codes")
    return {f"CTYPE{axis}": "STOKES", f"CRPIX{axis}": 1.0, f"CRVAL{axis}": float(codes[order[0]]), f"CDELT{axis}": float(steps.pop() if steps else 1)}, order


def image_header(pixels: int, pixel_size: float, wavelength: float, centre: tuple[float, float], pols: list[str], beam: tuple[float, float, float] | None = None, unit: str | None = "Jy/beam") -> dict:
    """World coordinates of an image whose l axis is flipped, so that right ascension grows to the left; the centre is pixel N / 2 of the unflipped one. Angles in degrees."""
    step = math.degrees(math.asin(pixel_size))
    head = ({"BUNIT": unit} if unit else {}) | {"TIMESYS": "UTC", "EQUINOX": 2000.0, "RADESYS": "FK5"}
    head |= {"CTYPE1": "RA---SIN", "CUNIT1": "deg", "CRPIX1": pixels * 0.5, "CRVAL1": math.degrees(centre[0]), "CDELT1": -step}
    head |= {"CTYPE2": "DEC--SIN", "CUNIT2": "deg", "CRPIX2": pixels * 0.5 + 1, "CRVAL2": math.degrees(centre[1]), "CDELT2": step}
    head |= polarization_axis(pols, 3)[0] | {"CTYPE4": "FREQ", "CUNIT4": "Hz", "CRPIX4": 1.0, "CRVAL4": 299792458.0 / wavelength, "CDELT4": 1.0}
    if beam is not None and all(map(math.isfinite, beam)):
        head |= {"BMAJ": math.degrees(beam[0] * pixel_size), "BMIN": math.degrees(beam[1] * pixel_size), "BPA": math.degrees(beam[2])}
    return head


def grid_header(pixels: int, cell_size: float, pols: list[str]) -> dict:
    axis = lambda i: {f"CUNIT{i}": "m", f"CRPIX{i}": pixels // 2 + 1.0, f"CRVAL{i}": 0.0, f"CDELT{i}": cell_size}
    return {"BUNIT": "Jy"} | axis(1) | axis(2) | polarization_axis(pols, 3)[0] | {"CTYPE4": "COMPLEX", "CRPIX4": 1.0, "CRVAL4": 1.0, "CDELT4": 1.0}


def _bytes(data: np.ndarray, header: dict) -> bytes:
    data = data.astype(">f4")
    cards = {"SIMPLE": True, "BITPIX": -32, "NAXIS": data.ndim} | {f"NAXIS{i + 1}": n for i, n in enumerate(reversed(data.shape))} | header
    head = b"".join(_card(k, v) for k, v in cards.items()) + b"END".ljust(80)
    body = data.tobytes()
    return head.ljust(-(-len(head) // BLOCK) * BLOCK) + body + b"\0" * (-len(body) % BLOCK)


def fits_bytes(image: np.ndarray, header: dict) -> bytes:
    """An image (pols, H, W) with the l axis flipped and an axis of frequency; DATAMIN and DATAMAX leave NaN out and are absent if nothing else is there."""
    finite = image[np.isfinite(image)]
    limits = {"DATAMIN": float(finite.min()), "DATAMAX": float(finite.max())} if finite.size else {}
    return _bytes(image[None, :, :, ::-1], header | limits)


def grid_bytes(grid: np.ndarray, header: dict) -> bytes:
    """A complex grid (pols, H, W) with an axis of real and imaginary part."""
    return _bytes(np.stack([grid.real, grid.imag]), header)


def downsample(image: np.ndarray, least: int = THUMBNAIL) -> tuple[np.ndarray, int]:
    """Block means of an image (H, W) by the largest power of two that divides it and leaves at least ``least`` pixels a side, and that power."""
    scale = 1
    while all(n % (2 * scale) == 0 and n // (2 * scale) >= least for n in image.shape):
        scale *= 2
    h, w = image.shape
    return image.reshape(h // scale, scale, w // scale, scale).mean(axis=(1, 3)), scale


def png_bytes(image: np.ndarray) -> bytes:
    """A grey picture of an image (H, W), north up: the lowest and highest hundredth are black and white, NaN is black."""
    good = image[np.isfinite(image)]
    low, high = np.percentile(good, [1, 99]) if good.size else (0.0, 1.0)
    grey = np.nan_to_num(np.clip((image - low) / (high - low or 1.0), 0, 1) * 255).astype(np.uint8)[::-1, ::-1]
    rows = np.column_stack([np.zeros(len(grey), np.uint8), grey])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


#: A row of the sink: a polarization of a channel's product; ``cell_size`` in metres, the beam in pixels and radians.
SCHEMA = "channel long, product string, pol int, pixels array<double>, wavelength double, pixel_size double, cell_size double, major double, minor double, angle double"


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are, and where they belong."""

    files: list[tuple[str, str]] = field(default_factory=list)


class FitsWriter(DataSourceArrowWriter):
    """A file for each (channel, product); all its rows are in one task, in the order of their polarizations (``write`` sees to that)."""

    def __init__(self, options: dict):
        self.fs, self.root = fs.FileSystem.from_uri(options["path"])
        self.pols = options.get("polarizations", "I").split(",")
        polarization_axis(self.pols, 3)
        self.pattern, self.prefix, self.metadata = options.get("pattern", "{product}-%05d.fits"), options.get("prefix"), json.loads(options.get("metadata", "{}"))
        if not self.prefix:
            self.pattern.format(product="x") % 0  # a pattern that takes no channel raises here
        self.centre = (float(options.get("ra", 0)), float(options.get("dec", 0)))
        self.extra, self.run = json.loads(options.get("headers", "{}")), uuid.uuid4().hex
        self.staging = f"{self.root}/.writing-{self.run}"

    def _put(self, path: str, data: bytes) -> None:
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(path) as out:
            out.write(data)

    def _files(self, rows: list[dict]) -> dict[str, bytes]:
        """Name: bytes of what a channel's product is written as."""
        r, order = rows[0], polarization_axis(self.pols, 3)[1]
        side = math.isqrt(len(r["pixels"]) // (2 if r["product"] == "grid" else 1))
        if len(rows) != len(self.pols):
            raise ValueError(f"channel {r['channel']} has {len(rows)} polarizations of {r['product']}, not {len(self.pols)}")
        data = np.stack([np.asarray(rows[i]["pixels"], float) for i in order])
        if r["product"] == "grid":  # real and imaginary part in turn
            whole = grid_bytes(data.view(complex).reshape(len(rows), side, side), grid_header(side, r["cell_size"], self.pols) | self.extra)
        else:
            image = data.reshape(len(rows), side, side)
            beam = None if r["major"] is None or r["product"] in ("weights", "model", "primary_beam") else (r["major"], r["minor"], r["angle"])
            head = image_header(side, r["pixel_size"], r["wavelength"], self.centre, self.pols, beam, None if r["product"] == "weights" else "Jy/beam")
            whole = fits_bytes(image, head | self.extra)
        if not self.prefix:
            return {self.pattern.format(product=r["product"]) % r["channel"]: whole}
        base = f"{self.prefix}_{r['channel']:05d}"
        frequency = 299792458.0 / r["wavelength"]
        about = self.metadata | {"FITSImageFilename": [f"{base}.fits"], "PNGThumbNailFileName": [f"{base}.fits.tnail.png"], "CenterFrequency": frequency, "Run": r["channel"]}
        folder = f"{base}_{self.run}"
        return {f"{folder}/{base}.fits": whole, f"{folder}/{base}.fits.tnail.png": png_bytes(downsample(image[0])[0]), f"{folder}/metadata.json": json.dumps(about, allow_nan=False, indent=2).encode()}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, now = Written(), []
        attempt = TaskContext.get().taskAttemptId()

        def put() -> None:
            for name, data in self._files(now).items() if now else ():
                held = f"{self.staging}/{attempt}/{name}"
                self._put(held, data)
                done.files.append((held, f"{self.root}/{name}"))

        for batch in iterator:
            for r in batch.to_pylist():
                if now and (r["channel"], r["product"]) != (now[0]["channel"], now[0]["product"]):
                    put()
                    now = []
                now.append(r)
        put()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for held, place in m.files if m else ():
                self.fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                self.fs.move(held, place)
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        if self.fs.get_file_info(self.staging).type != fs.FileType.NotFound:
            self.fs.delete_dir(self.staging)


class FitsFiles(DataSource):
    """Options: path; polarizations (I,Q,...); pattern, a name with {product} and %d of the channel, or prefix, for a folder a channel with FITS, thumbnail and
    metadata.json; ra and dec of the centre in radians; headers and metadata, JSON."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FitsWriter:
        return FitsWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsFiles)


def write(rows: DataFrame, path: str, **options: str) -> None:
    """Write rows of SCHEMA under ``path``; files appear when all are complete, and none if the job fails."""
    register(rows.sparkSession)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    dealt = rows.select(*columns).repartition("channel", "product").sortWithinPartitions("channel", "product", "pol")
    dealt.write.format("fits").mode("append").options(path=path, **options).save()
