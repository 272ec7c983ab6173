"""Input tables: one Parquet path per name below a data directory."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet``, through Spark's reader only, so any store Spark can reach will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
