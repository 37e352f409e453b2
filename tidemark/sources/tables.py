"""Reading tables, with naive timestamps as UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_utc(df: DataFrame) -> DataFrame:
    """df with its timestamp_ntz columns as timestamps, taken for UTC."""
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.to_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()) for c in naive}) if naive else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; timestamp_ntz columns become timestamps in UTC."""
    return as_utc(spark.read.parquet(f"{folder}/{name}.parquet"))


def csv(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep)


def partition_number(key: str, size: int):  # noqa: ANN201
    """Number of the range partition of a whole-number key: partition n holds [n * size, (n + 1) * size)."""
    return F.floor(F.col(key) / size).cast("long")
