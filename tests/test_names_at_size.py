"""Names of a file of one row group are normalised on all cores, once a row, and cheaply where plain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dossier.functions import text
from dossier.operators.vocabulary import union_synonyms
from dossier.session import shared_folder


@pytest.fixture(scope="module")
def folder(spark):
    folder = shared_folder(spark, "tables")
    ids = spark.range(1, 9)
    tables = {
        "part": ids.select(
            F.col("id").alias("p_partkey"), F.expr("'name ' || id").alias("p_name"), F.lit("B").alias("p_brand"),
            F.lit("T").alias("p_type"), F.col("id").cast("int").alias("p_size"), F.lit(900.0).alias("p_retailprice"),
        ),
        "lineitem": ids.selectExpr(
            "id AS l_orderkey", "id AS l_partkey", "1 + id % 8 AS l_suppkey", "1 AS l_linenumber", "'N' AS l_returnflag", "'F' AS l_linestatus"
        ),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["e5_name_dictionary", "e6_exact_names", "e8_code_routing", "e8_inferred_candidates", "v8_synonym_union"])
def test_names_of_one_file_are_normalised_after_they_are_dealt_out(spark, folder, name):
    rows = entry.queries()[name](spark, folder)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan
    assert not re.search(r"RoundRobinPartitioning(?:(?!FileScan).)*ArrowEvalPython", plan, re.DOTALL)
    assert rows.count() >= 7


def test_a_filter_on_the_key_does_not_normalise_twice(spark, folder):
    names = spark.read.parquet(f"{folder}/part.parquet").select(text.normalize_name(F.col("p_name")).alias("key"))
    plan = names.where("key <> ''")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_short_tests_agree_with_all_ranges(spark):
    chars = spark.range(1, 0x10000).where("id NOT BETWEEN 55296 AND 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")
    )
    for fold in (False, True):
        differing = chars.where(text._unsettled(F.col("c"), fold) != F.col("c").rlike(text.unsettled(fold)))
        assert differing.count() == 0
    keys = spark.createDataFrame([("*ST ａbc 股份有限公司",), ("集团",), ("x　y",), (None,), ("é集团公司",)], "n string")
    assert [r.k for r in keys.select(text.normalize_name(F.col("n")).alias("k")).collect()] == ["ABC", "集团", "XY", "", "É"]


def test_spellings_that_differ_in_outer_spaces_are_one_synonym(spark):
    names = spark.createDataFrame([(1, 5, " a b"), (1, 3, "ab "), (1, 4, "ab"), (1, 1, "  "), (1, 2, None), (1, 9, "own")], "theme_id int, position long, name string")
    own = spark.createDataFrame([(1, "o wn")], "theme_id int, name string")
    assert [tuple(r) for r in union_synonyms(names, own).collect()] == [(1, 3, "ab")]
