"""Image products by channel, with restart: what is written counts as done and is not made again."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fits

#: Product name: column of the images.
PRODUCTS = {"clean": "restored", "model": "model", "residuals": "residual", "psf": "psf", "dirty": "dirty", "primary_beam": "primary_beam", "weights": "weights", "grid": "grid"}
STATISTICS = ("noise", "peak", "total", "cycles", "majors", "major", "minor", "angle", "patch_height", "patch_width", "weights_noise", "normalized_noise", "compressed_vis")


def unrolled(images: DataFrame, products: tuple[str, ...]) -> DataFrame:
    """(channel, pol, product, pixels): a row for each product; null ones have none."""
    unknown = set(products) - set(PRODUCTS)
    if unknown:
        raise ValueError(f"no products named {sorted(unknown)}")
    missing = [p for p in products if PRODUCTS[p] not in images.columns]
    if missing:
        raise ValueError(f"the images were made without {missing}")
    each = F.array(*[F.struct(F.lit(p).alias("product"), F.col(PRODUCTS[p]).alias("pixels")) for p in products])
    return images.select("channel", "pol", F.explode(each).alias("r")).select("channel", "pol", "r.*").where("pixels is not null")


class Writer(ABC):
    """Where images go. ``done`` tells what a former run finished; ``statistics`` is the last thing written of a channel, with its status."""

    #: Products that are wanted.
    products: tuple[str, ...] = ("clean",)

    def needs(self, product: str) -> bool:
        return product in self.products

    def done(self, spark: SparkSession) -> DataFrame:
        """(channel, status) of the channels that need no more work."""
        return spark.createDataFrame([], "channel long, status string")

    @abstractmethod
    def write(self, images: DataFrame, params: DataFrame) -> None: ...

    def statistics(self, images: DataFrame) -> None:
        """Statistics of the channels that were made, which are then complete."""

    def skip(self, channels: DataFrame) -> None:
        """Channels (channel) without usable data."""


class TableWriter(Writer):
    """Parquet folders under ``path``: images by channel and product, statistics and status by channel. A run that stops before a channel's status is written leaves
    it open; the next one overwrites just its folders, so nothing is there twice."""

    def __init__(self, path: str, products: tuple[str, ...] = ("clean", "model", "residuals", "psf")):
        self.path, self.products = path.rstrip("/"), tuple(products)
        if unknown := set(products) - set(PRODUCTS):
            raise ValueError(f"no products named {sorted(unknown)}")

    def _keyed(self, rows: DataFrame, folder: str, *by: str) -> None:
        rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{folder}")

    def done(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema("status string, channel long").parquet(f"{self.path}/status").select("channel", "status")
        except AnalysisException:
            return super().done(spark)

    def write(self, images: DataFrame, params: DataFrame) -> None:
        self._keyed(unrolled(images, self.products), "images", "channel", "product")

    def statistics(self, images: DataFrame) -> None:
        self._keyed(images.select("pol", *STATISTICS, "channel"), "statistics", "channel")
        self._keyed(images.select(F.lit("complete").alias("status"), "channel").distinct(), "status", "channel")

    def skip(self, channels: DataFrame) -> None:
        self._keyed(channels.select(F.lit("no-data").alias("status"), "channel"), "status", "channel")


class FitsFileWriter(TableWriter):
    """FITS files by a pattern of product and channel, or a folder a channel with thumbnail and metadata; statistics and status are tables beside them."""

    def __init__(self, path: str, products: tuple[str, ...] = ("clean",), polarizations: tuple[str, ...] = ("I",), **options: str):
        super().__init__(path, products)
        self.options = {"polarizations": ",".join(polarizations), **options}

    def write(self, images: DataFrame, params: DataFrame) -> None:
        beams = images.select("channel", "major", "minor", "angle").dropDuplicates(["channel"])
        rows = unrolled(images, self.products).join(beams, "channel").join(params.select("channel", "wavelength", "pixel_size", "cell_size"), "channel")
        fits.write(rows.withColumn("pol", F.col("pol").cast("int")), self.path, **self.options)


def remaining(params: DataFrame, writer: Writer) -> DataFrame:
    """The rows (channel, ...) of channels that have no status yet."""
    return params.join(writer.done(params.sparkSession).select("channel"), "channel", "left_anti")
