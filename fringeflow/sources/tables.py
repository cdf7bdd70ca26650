"""Table catalogue: Parquet folders by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temporary views of the tables; scans stay lazy, so filters and columns reach Parquet."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
