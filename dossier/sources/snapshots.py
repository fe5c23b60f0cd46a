"""Versioned snapshots: immutable parquet per write, the head found by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(rows: DataFrame, folder: str) -> str:
    """Write to a folder of its own; a job never overwrites what it reads."""
    rows.write.mode("errorifexists").parquet(folder)
    return folder


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty for every table whose key is an invariant."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def write_bucketed(rows: DataFrame, table: str, keys: list[str], buckets: int) -> DataFrame:
    """Write as a table clustered by the join keys of the views.

    Reports bucketed by (id, current_analysis_id) and projections bucketed by (report_id,
    analysis_id) with equal counts meet without any exchange.
    """
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).mode("errorifexists").saveAsTable(table)
    return rows.sparkSession.table(table)


def read_head(spark: SparkSession, folder: str, key: str, version: str) -> DataFrame:
    """The row of the highest version per key, by a map-side combined maximum and a join back."""
    rows = spark.read.parquet(folder)
    heads = rows.groupBy(key).agg(F.max(version).alias(version))
    return rows.join(heads, [key, version], "left_semi")
