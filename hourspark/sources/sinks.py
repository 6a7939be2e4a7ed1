"""Writers: Parquet tables, ordered tables with their order check, reports, previews, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourspark.operators.quality import ContractError, schema_hash


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "errorifexists", block_bytes: int | None = None) -> None:
    """ZSTD Parquet; ``block_bytes`` bounds the row groups."""
    writer = df.write.mode(mode).option("compression", "zstd")
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_ordered(df: DataFrame, path: str, key: list[str]) -> None:
    """Range-partitioned and sorted Parquet; file names follow the key order."""
    df.orderBy(*key).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def order_faults(written: DataFrame, key: list[str]) -> DataFrame:
    """(faults) of a written table: rows out of strict key order in a file, and files that overlap.

    Rows are compared inside their file by its row index; across files only the bounds are compared.
    """
    row = F.struct(*key)
    keyed = written.select(
        F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"), row.alias("k")
    )
    # A file of an ordered table is one range of bounded size, so it can be one window.
    in_file = Window.partitionBy("f").orderBy("i")
    inside = keyed.withColumn("before", F.lag("k").over(in_file)).agg(F.count_if(F.col("k") <= F.col("before")).alias("n"))
    bounds = keyed.groupBy("f").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    w = Window.orderBy("f")  # one row per file
    between = bounds.withColumn("before", F.lag("hi").over(w)).agg(F.count_if(F.col("lo") <= F.col("before")).alias("n"))
    return inside.unionByName(between).agg(F.sum("n").alias("faults"))


def require_order(written: DataFrame, key: list[str]) -> None:
    faults = order_faults(written, key).first().faults
    if faults:
        raise ContractError(f"table is not strictly ordered by {key}: {faults} faults")


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV in a fixed row order, nulls last."""
    df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).write.mode("errorifexists").csv(path, header=True)


def write_preview(df: DataFrame, path: str, order: list[str], n: int = 250) -> None:
    """The first ``n`` rows as one CSV file."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def manifest(df: DataFrame, facts: dict[str, Column], by_split: str | None = None) -> DataFrame:
    """One JSON row: row count, chosen aggregates, schema and its hash, and the rows of each split."""
    fields = [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]
    schema = F.array(*[F.struct(F.lit(x["name"]).alias("name"), F.lit(x["type"]).alias("type")) for x in fields])
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in facts.items()])
    parts = ["rows", *facts]
    if by_split:
        counts = df.groupBy(by_split).agg(F.count(F.lit(1)).alias("n")).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(by_split, "n")))).alias("m")
        )
        totals = totals.withColumn("split_rows", counts.scalar())
        parts.append("split_rows")
    return totals.select(F.to_json(F.struct(
        *parts, schema.alias("schema"), F.lit(schema_hash(df)).alias("schema_hash")
    )).alias("manifest"))


def write_manifest(manifest_row: DataFrame, path: str) -> None:
    manifest_row.coalesce(1).write.mode("errorifexists").text(path)
