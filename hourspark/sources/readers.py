"""File scans with explicit schemas and discovery of sources by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourspark.functions.text import text_point
from hourspark.operators.quality import ContractError, require_columns


def text_schema(names: list[str]) -> T.StructType:
    """All columns as text, so that parsing and its refusals stay explicit."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, sep: str = ",") -> DataFrame:
    """Headed delimited files, quotes doubled inside quotes; a header that differs from ``schema`` fails."""
    return spark.read.csv(paths, schema=schema, header=True, sep=sep, escape='"', enforceSchema=False, mode="FAILFAST")


def read_parquet(spark: SparkSession, paths: list[str], columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files as one relation; with ``schema`` no file footer decides the types."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(*paths)
    return require_columns(df, columns, "parquet").select(*columns) if columns else df


def with_source(df: DataFrame, prefix: str, name: str = "source_dataset_id") -> DataFrame:
    """Source id of each row: the first path part that starts with ``prefix``, else the file stem."""
    path = F.col("_metadata.file_path")
    named = F.regexp_extract(path, f"/({prefix}[^/.]*)", 1)
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)*$", 1)
    return df.select("*", F.when(named != "", named).otherwise(stem).alias(name))


def discover(spark: SparkSession, folder: str, pattern: str, prefix: str, allowed: list[str] | None = None) -> DataFrame:
    """(file, source_dataset_id) of the archives under ``folder``; missing allowed sources fail."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    )
    found = with_source(files.select("path", "_metadata"), prefix).select(F.col("path").alias("file"), "source_dataset_id")
    if allowed is None:
        return found
    if not allowed:
        raise ContractError("discovery needs a non-empty list of allowed sources")
    wanted = spark.createDataFrame([(a,) for a in allowed], "source_dataset_id string")
    absent = [r[0] for r in wanted.join(found, "source_dataset_id", "left_anti").collect()]
    if absent:
        raise ContractError(f"configured sources were not found: {sorted(absent)}")
    return found.join(F.broadcast(wanted), "source_dataset_id", "left_semi").select("file", "source_dataset_id")


def read_point_lines(spark: SparkSession, path: str, header: str = "geo_point_2d") -> DataFrame:
    """(lon, lat) of a one-column file of ``lat, lon`` texts; blank lines are skipped."""
    lines = spark.read.text(path).withColumn("value", F.trim(F.regexp_replace("value", "﻿|\"", "")))
    point = text_point(F.col("value"))
    return lines.filter((F.col("value") != "") & (F.col("value") != header)).select(point["lon"].alias("lon"), point["lat"].alias("lat"))
