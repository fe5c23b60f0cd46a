"""Inputs that once gave wrong results."""

from pyspark.sql import functions as F

from dossier.operators.extraction import normalize_result, repair_json
from dossier.operators.identity import dispose_references, manual_downloads, merge_identities
from dossier.operators.master import bridge_vote
from dossier.operators.synthesis import cited_items
from dossier.operators.vocabulary import merge_verdicts


def test_vote_with_letters_in_the_code(spark):
    members = spark.createDataFrame([("i1", "c1"), ("i1", "c2"), ("i2", "c3")], "index_code string, code string")
    codes = spark.createDataFrame([("c1", "S1"), ("c2", "S1"), ("c3", "A9")], "code string, industry_code string")
    assert {r.index_code: r.industry_code for r in bridge_vote(members, codes, 2).collect()} == {"i1": "S1", "i2": "A9"}


def test_new_report_takes_no_deleted_id(spark):
    files = spark.createDataFrame([(1, "T", "t", "b", "2024-01-01")], "arrival long, title string, title_norm string, broker string, publish_date string")
    reports = spark.createDataFrame([(1, "x", "b", "2024-01-01", False), (7, "y", "b", "2024-01-01", True)], "id long, title_norm string, broker string, publish_date string, deleted boolean")
    got = merge_identities(files, reports.where(~F.col("deleted")), reports).first()
    assert got.report_id == 8


def test_citation_in_full_width_digits(spark):
    df = spark.createDataFrame([(1, '{"common_conclusions":[{"text":"a","report_refs":["２"," 1２ ",3]}]}', 12)], "theme_id int, raw string, n_reports int")
    assert cited_items(repair_json(df)).first().refs == [2, 3, 12]


def test_ingested_reference_takes_no_deleted_id(spark):
    refs = spark.createDataFrame([(1, "t", "b", "2024-01-01", True, True)], "position long, title_norm string, broker string, publish_date string, auto_download boolean, fetch_ok boolean")
    reports = spark.createDataFrame([(1, "x", "b", "2024-01-01", False), (7, "y", "b", "2024-01-01", True)], "id long, title_norm string, broker string, publish_date string, deleted boolean")
    assert dispose_references(refs, reports.where(~F.col("deleted")), reports).first().report_id == 8


def test_false_and_zero_say_nothing(spark):
    raw = '{"broker":false,"title":0,"summary":"0","risk_notes":0.0,"targets":[{"name":"A","code":"","view":false},{"name":0}],"themes":[{"name":"false","reason":0}],"authors":[{"name":"B","cert":0}, 5]}'
    df = spark.createDataFrame([(raw, "body")], "raw string, body string")
    got = normalize_result(repair_json(df)).first().result
    assert (got.broker, got.title, got.summary, got.risk_notes) == ("", "", "0", "")
    assert [(t.name, t.view) for t in got.targets] == [("A", "")]
    assert [(t.name, t.reason) for t in got.themes] == [("false", "")]
    assert [(a.name, a.cert) for a in got.authors] == [("B", None)]


def test_refused_merges_hold_nothing_up(spark):
    themes = spark.createDataFrame([(1, "active"), (2, "active"), (3, "retired"), (4, "active")], "id long, status string")
    asked = spark.createDataFrame([(1, 2, 3), (2, 2, 1), (3, 1, 1), (4, 4, 1), (5, 4, 1)], "arrival long, src long, dst long")
    got = {r.arrival: r.verdict for r in merge_verdicts(asked, themes).collect()}
    assert got == {1: "target_not_active", 2: "ok", 3: "self", 4: "ok", 5: "later_batch"}


def test_differing_requests_of_one_reference(spark):
    rows = [(1, "seen", True, "c", 1, "x"), (1, "seen", False, "c", 1, "x"), (2, "ingested", True, "c", 1, "y")]
    schema = "ref_id long, status string, fetch_ok boolean, connector_id string, subscription_id long, external_id string"
    for order in (rows, rows[::-1]):
        outcome, _ = manual_downloads(spark.createDataFrame(order, schema))
        assert {r.ref_id: r.outcome for r in outcome.collect()} == {1: "fetch_failed", 2: "skipped"}
