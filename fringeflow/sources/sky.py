"""Sky models: catalogues of point sources as text, and their flux and direction as columns."""

from __future__ import annotations

from urllib.parse import parse_qs, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers in a flux model: band edges in MHz, six coefficients, fractions of I, Q, U, V.
COEFFICIENTS, STOKES = 6, 4


#: What a stream of continuum images may be called.
CONTINUUM = ("sdp.continuum_image", "continuum_image")


class NoSkyModel(ValueError):
    """There is no sky model, or more than one."""


def open_sky_model(spark: SparkSession, url: str) -> DataFrame:
    """The sources of ``url``, a file unless it has another scheme.

    ``format`` is katpoint, a text catalogue in a file (also where none is named), parquet, a table of the catalogue's columns, or archive, an archive's folder with the table
    ``streams`` (stream, kind, target, line); that needs ``target`` and takes ``continuum``, a stream's name. ValueError for others, NoSkyModel where an archive has none.
    """
    parts = urlparse(url, scheme="file")
    query = parse_qs(parts.query)
    kind = query.get("format", ["katpoint"])[0]
    if kind == "katpoint":
        if parts.scheme != "file":
            raise ValueError(f"a text catalogue needs a file:// address, not {parts.scheme!r}")
        return parse_catalogue(spark.read.text(parts.path))
    plain = parts._replace(query="").geturl()
    if kind == "parquet":
        return spark.read.parquet(plain)
    if kind == "archive":
        if "target" not in query:
            raise ValueError("an archive's address needs a target")
        return stream_catalogue(spark.read.parquet(f"{plain.rstrip('/')}/streams"), query["target"][0], query.get("continuum", [None])[0])
    raise ValueError(f"no sky model of format {kind!r}")


def stream_catalogue(streams: DataFrame, target: str, stream: str | None = None) -> DataFrame:
    """The sources found for ``target`` by ``stream``, or by the one continuum stream among rows (stream, kind, target, line); NoSkyModel unless there is just one and it
    has the target."""
    if stream is None:
        names = streams.where(F.col("kind").isin(*CONTINUUM)).select("stream").distinct().limit(2).collect()
        if len(names) != 1:
            raise NoSkyModel("no continuum stream" if not names else "more than one continuum stream: one must be chosen")
        stream = names[0]["stream"]
    lines = streams.where((F.col("stream") == stream) & (F.col("target") == target)).select(F.col("line").alias("value"))
    if not lines.limit(1).count():
        raise NoSkyModel(f"stream {stream} has no sky model of {target}")
    return parse_catalogue(lines)


def _angle(text: Column, per: int) -> Column:
    """Radians of ``h:m:s`` (per = 15) or ``d:m:s`` (per = 1), or of plain degrees."""
    parts = F.transform(F.split(text, ":"), lambda x: F.abs(x.try_cast("double")))
    whole = F.aggregate(F.reverse(parts), F.lit(0.0), lambda total, x: total / 60 + x)
    size = F.when(F.size(parts) > 1, whole * per).otherwise(whole)
    return F.radians(F.when(F.startswith(F.trim(text), F.lit("-")), -size).otherwise(size))


def parse_catalogue(lines: DataFrame) -> DataFrame:
    """(name, ra, dec, min_hz, max_hz, coefficients, stokes) of lines ``name, radec, ra, dec, (min max c0 ... I Q U V)`` in ``value``.

    Blank lines, comments and targets without a position are left out; a source without a flux model has null there and gives no flux. Missing coefficients
    are 0 and missing Stokes fractions are those of an unpolarised source.
    """
    field = F.split("value", r",(?![^(]*\))")
    at = lambda i: F.trim(F.try_element_at(field, F.lit(i + 1)))
    numbers = F.transform(F.split(F.trim(F.regexp_extract("value", r"\(([^)]*)\)", 1)), r"[\s,]+"), lambda x: x.try_cast("double"))
    d = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select(
        F.trim(F.regexp_replace(F.element_at(F.split(at(0), r"\|"), 1), r"^\*", "")).alias("name"), at(1).alias("tags"), at(2).alias("a"), at(3).alias("d"),
        F.when(F.col("value").contains("("), numbers).alias("numbers"),
    )
    number = lambda i, missing: F.coalesce(F.try_element_at("numbers", F.lit(i + 1)), F.lit(missing))
    has = F.col("numbers").isNotNull()
    return d.where(F.col("tags").rlike(r"\bradec\b")).select(
        "name", _angle(F.col("a"), 15).alias("ra"), _angle(F.col("d"), 1).alias("dec"),
        (F.try_element_at("numbers", F.lit(1)) * 1e6).alias("min_hz"), (F.try_element_at("numbers", F.lit(2)) * 1e6).alias("max_hz"),
        F.when(has, F.array(*[number(2 + i, 0.0) for i in range(COEFFICIENTS)])).alias("coefficients"),
        F.when(has, F.array(*[number(2 + COEFFICIENTS + i, 1.0 if i == 0 else 0.0) for i in range(STOKES)])).alias("stokes"),
    )


def flux_density(frequency: Column) -> Column:
    """Stokes I, Q, U, V of sources at a frequency in Hz: 10 ** polynomial in log10(MHz); zeros outside the band and without a model."""
    x = F.log10(frequency / 1e6)
    power = F.aggregate(F.reverse("coefficients"), F.lit(0.0), lambda total, c: total * x + c)
    inside = F.col("coefficients").isNotNull() & (frequency >= F.col("min_hz")) & (frequency <= F.col("max_hz"))
    return F.when(inside, F.transform("stokes", lambda s: F.pow(F.lit(10.0), power) * s)).otherwise(F.array(*[F.lit(0.0)] * STOKES))


def direction_cosines(ra0: float, dec0: float) -> tuple[Column, Column, Column]:
    """l, m and n - 1 of sources (ra, dec) about a phase centre; n - 1 without cancellation near the centre."""
    turn, dec = F.col("ra") - ra0, F.col("dec")
    half = lambda angle: F.pow(F.sin(angle / 2), F.lit(2.0))
    less = -2 * (half(dec - dec0) + F.cos(dec) * F.cos(F.lit(dec0)) * half(turn))
    return F.cos(dec) * F.sin(turn), F.sin(dec) * F.cos(F.lit(dec0)) - F.cos(dec) * F.sin(F.lit(dec0)) * F.cos(turn), less
