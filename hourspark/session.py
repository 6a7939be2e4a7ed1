"""Session settings, and tables written to cut lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "hourspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  A session without that setting gets a folder beside its
    warehouse tables, which all its executors see as well.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    return folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "steps")


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for one run's written tables."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    The lineage ends at the written files, which outlive any executor, and the file sizes give the
    optimizer true statistics for the next round's joins.
    """
    path = run_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_value(df: DataFrame) -> Column:
    """A one-row, one-column DataFrame as a scalar subquery column."""
    return df.scalar()
