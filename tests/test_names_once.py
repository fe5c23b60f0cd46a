"""Names are stripped by comparison, looked up per set of names, and mentions are routed once."""

import itertools
import re

from pyspark.sql import functions as F

from dossier.functions import constants as K
from dossier.functions import text
from dossier.operators import resolve


def _by_pattern(name):
    while True:
        short = name
        for suffix in K.COMPANY_SUFFIXES:
            short = re.sub(f"(?<=.){suffix}$", "", short)
        if short == name:
            return name
        name = short


def test_suffixes_are_compared_in_their_order(spark):
    parts = ["公司", "集团", "控股", "有限", "股份", "责任"]
    names = ["".join(p) for n in range(1, 5) for p in itertools.product(parts, repeat=n)]
    names += ["甲" + n for n in names] + ["ab" + n + "x" for n in names[:50]]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    key = text.normalize_name(F.col("n"))
    assert "(?<=.)" not in rows.select(key)._jdf.queryExecution().analyzed().toString()
    got = {r.n: r.k for r in rows.select("n", key.alias("k")).collect()}
    assert got == {n: _by_pattern(n.upper()) for n in names}


def test_codes_of_equal_names_are_one_hit_until_they_are_listed(spark, monkeypatch):
    sizes, write = [], resolve.cut_lineage

    def counted(df, purpose="stage"):
        stored = write(df, purpose)
        if purpose == "fuzzy-hits":
            sizes.append(stored.count())
        return stored

    monkeypatch.setattr(resolve, "cut_lineage", counted)
    # 40 codes with the same two names, one with one of them, one without a code
    rows = [(k, f"{c:03d}") for c in range(40) for k in ("LONGNAME", "LONGNAMED")]
    rows += [("LONGNAME", "900"), ("LONGNAME", None), ("QQQQQQ", "901")]
    dictionary = spark.createDataFrame(rows, "key string, code string")
    names = spark.createDataFrame([("LONGNAMEX",), ("QQQQQQR",), ("ZZ",)], "key string")
    verdicts, candidates = resolve.fuzzy_stage(names, dictionary, 3)
    assert sizes[0] == 3
    assert {tuple(r) for r in verdicts.collect()} == {
        ("LONGNAMEX", None, "multi_candidate"), ("QQQQQQR", "901", None), ("ZZ", None, "no_hit"),
    }
    listed = {(r.key, r.code): r.score for r in candidates.collect()}
    best = round(2 * 8 / 17, 3)
    assert len(listed) == candidates.count() == 42
    assert set(listed.values()) == {best} and ("LONGNAMEX", None) in listed and ("LONGNAMEX", "900") in listed


def test_mentions_are_routed_once_for_the_hints(spark, tmp_path):
    rows = [("A", "000002", True), ("A", "000009", True), ("B", "000002", False), ("A", "000002", True), ("C", "000007", True)]
    spark.createDataFrame(rows, "key string, raw_code string, in_master boolean").withColumn("reason", F.lit("inferred_code")).write.parquet(f"{tmp_path}/routed")
    routed = spark.read.parquet(f"{tmp_path}/routed")
    verdicts = spark.createDataFrame([("A", None, "multi_candidate"), ("B", "000001", None)], "key string, code string, reason string")
    candidates = spark.createDataFrame([("A", "000001", 1.0), ("A", "000002", 1.0)], "key string, code string, score double")
    hints = resolve.inferred_candidates(routed, verdicts, candidates, 5)
    assert hints._jdf.queryExecution().optimizedPlan().toString().count("in_master#") and len(
        re.findall(r"Relation \[", hints._jdf.queryExecution().optimizedPlan().toString())
    ) == 1
    assert sorted((r.key, r.raw_code, r.rank, r.code) for r in hints.collect()) == [
        ("A", "000002", 1, "000001"), ("A", "000002", 2, "000002"),
        ("A", "000009", 1, "000009"), ("A", "000009", 2, "000001"), ("A", "000009", 3, "000002"),
        ("B", "000002", 1, "000001"), ("C", "000007", 1, "000007"),
    ]
