"""Readers: the driver's tables, and files of other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, with a declared schema: nothing is read to infer it."""
    return spark.read.schema(schema).json(path)


def binary_objects(spark: SparkSession, path: str) -> DataFrame:
    """Files as objects: key, size, last_modified_ms, content."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("last_modified_ms"), "content")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
