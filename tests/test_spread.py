"""Queries that multiply the rows of a small file deal them out to all cores first."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dossier.session import shared_folder


@pytest.mark.parametrize("name", ["v12_query_words", "v12_display_terms"])
def test_themes_of_one_file_are_dealt_out(spark, name):
    folder = shared_folder(spark, "tables")
    parts = spark.range(1, 9).select(
        F.col("id").alias("p_partkey"), F.expr("'name ' || id").alias("p_name"), F.lit("B").alias("p_brand"),
        F.lit("T").alias("p_type"), F.col("id").cast("int").alias("p_size"), F.lit(900.0).alias("p_retailprice"),
    )
    parts.coalesce(1).write.parquet(f"{folder}/part.parquet")
    rows = entry.queries()[name](spark, folder)
    assert "RoundRobinPartitioning" in rows._jdf.queryExecution().toString()
    assert rows.select("id").distinct().count() == 8
