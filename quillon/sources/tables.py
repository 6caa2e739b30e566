"""Readers of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of long texts, whose rows are work enough to be spread over all cores where the files give fewer partitions.
TEXTS = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer partitions than that, as one small file does; unchanged beyond."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXTS else df
