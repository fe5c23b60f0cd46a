"""Scans of the master list, the industry code table and the concept snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import is_noise_concept, valid_code
from ..functions.text import strip

MASTER_SCHEMA = "code string, name string"
INDUSTRY_SCHEMA = (
    "l1_code string, l1_name string, l2_code string, l2_name string, l3_code string, l3_name string"
)
SNAPSHOT_SCHEMA = (
    "generated_at string, source string, failed_boards array<string>, "
    "concepts array<struct<code:string,name:string,members:array<string>,stale:boolean>>"
)


def clean_master_list(rows: DataFrame) -> DataFrame:
    """Rows with a six-digit code; dirty rows are dropped."""
    return rows.where(valid_code(F.col("code")))


def read_master_list(spark: SparkSession, path: str) -> DataFrame:
    return clean_master_list(spark.read.schema(MASTER_SCHEMA).option("header", True).csv(path))


def read_industry_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDUSTRY_SCHEMA).option("header", True).csv(path)


def concept_seeds(snapshot: DataFrame) -> DataFrame:
    """Boards of a snapshot as seeds: noise and blank names dropped, only six-digit members."""
    boards = snapshot.select(F.explode("concepts").alias("c")).select(
        F.coalesce("c.code", F.lit("")).alias("seed_code"),
        strip(F.coalesce("c.name", F.lit(""))).alias("name"),
        F.filter(F.coalesce("c.members", F.array().cast("array<string>")), valid_code).alias("members"),
    )
    return boards.where((F.col("name") != "") & ~is_noise_concept(F.col("name")))


def read_concept_seeds(spark: SparkSession, path: str) -> DataFrame:
    return concept_seeds(spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).json(path))


def merge_snapshot(boards: DataFrame, fetched: DataFrame, previous: DataFrame) -> DataFrame:
    """Refresh: the board list decides which boards exist and how they are called.

    A fetched board brings new members; a failed one keeps its former members, marked stale;
    a failed board without former members is absent.
    """
    new = fetched.select("code", F.col("members").alias("_new"), F.lit(True).alias("_fetched"))
    old = previous.select("code", F.col("members").alias("_old"), F.lit(True).alias("_known"))
    stale = F.col("_fetched").isNull()
    return (
        boards.join(new, "code", "left")
        .join(old, "code", "left")
        .where(~stale | F.col("_known").isNotNull())
        .select(
            "code",
            "name",
            F.when(stale, F.col("_old")).otherwise(F.col("_new")).alias("members"),
            stale.alias("stale"),
        )
    )
