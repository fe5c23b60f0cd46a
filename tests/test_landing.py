"""Sources, extraction landing and citations."""

import json
import random

from pyspark.sql import functions as F

from dossier.operators import extraction, retrieval, synthesis
from dossier.sources import connector, files, master


def test_binary_files_land_with_reasons(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"body")
    (tmp_path / "b.txt").write_bytes(b"x")
    rows = {r.filename: r for r in files.land_files(files.scan_files(spark, str(tmp_path))).collect()}
    assert rows["a.pdf"].size_bytes == 4 and len(rows["a.pdf"].sha256) == 64 and rows["a.pdf"].reject_reason is None
    assert rows["b.txt"].reject_reason == "unsupported_format" and rows["b.txt"].sha256 is None


def test_master_scans(spark, tmp_path):
    (tmp_path / "m.csv").write_text("code,name\n600000,浦发\n12345,坏\n0000001,坏\n", encoding="utf-8")
    assert [r.code for r in master.read_master_list(spark, str(tmp_path / "m.csv")).collect()] == ["600000"]
    snapshot = {"concepts": [
        {"code": "BK1", "name": " 固态电池 ", "members": ["600000", "x", "1234567"]},
        {"code": "BK2", "name": "昨日涨停", "members": ["600000"]}, {"code": "BK3", "name": "", "members": []}, {"code": "BK4", "name": "空"},
    ]}
    (tmp_path / "s.json").write_text(json.dumps(snapshot, ensure_ascii=False, indent=1), encoding="utf-8")
    rows = master.read_concept_seeds(spark, str(tmp_path / "s.json")).orderBy("seed_code").collect()
    assert [(r.seed_code, r.name, r.members) for r in rows] == [("BK1", "固态电池", ["600000"]), ("BK4", "空", [])]


def test_snapshot_merge(spark):
    boards = spark.createDataFrame([("a", "A2"), ("b", "B"), ("c", "C")], "code string, name string")
    fetched = spark.createDataFrame([("a", ["1"])], "code string, members array<string>")
    previous = spark.createDataFrame([("a", ["0"]), ("b", ["2"]), ("gone", ["3"])], "code string, members array<string>")
    rows = {r.code: (r.name, r.members, r.stale) for r in master.merge_snapshot(boards, fetched, previous).collect()}
    assert rows == {"a": ("A2", ["1"], False), "b": ("B", ["2"], True)}


def test_search_response(spark):
    entry = {"reportId": 7, "title": "<em>T</em>", "pubTime": 1700000000000, "orgName": "", "pageNum": 0, "paragraphs": "x"}
    payloads = [
        {"data": [entry, {**entry, "pubTime": "1700000000", "pubTimeStr": "2024-2-3"}, {**entry, "pubTime": True}, 3, {**entry, "title": "<em> </em>"}]},
        {"code": 1, "msg": "no"}, {"data": "x"},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "id int, payload string")
    rows = connector.search_references(df).orderBy("position").collect()
    assert [(r.external_id, r.title, str(r.publish_date), r.published_at is None, r.broker, r.pages, r.snippet) for r in rows] == [
        ("7", "T", "2023-11-14", False, None, None, None), ("7", "T", "2024-02-03", True, None, None, None),
    ]
    assert [(r.id, r.code, r.message) for r in connector.bad_responses(df).orderBy("id").collect()] == [(1, "1", "no"), (2, None, "")]


def test_download_url(spark):
    payloads = ['{"data":" u "}', '{"data":{"url":"v"},"fileurl":""}', '{"url":1,"data":{"downloadurl":"w"}}', '{"data":[]}', "x"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(connector.download_url(F.col("p"))).collect()] == ["u", "v", "w", None, None]


def test_json_repair(spark):
    raws = ['```json\n{"a":1}\n```', 'so: {"a":{"b":2}} ok', "[1]", '{"a":1', "", "null", '"x {} y"', "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    rows = extraction.repair_json(df).orderBy("i").select("error", F.col("payload").cast("string").alias("p")).collect()
    bad = "llm_invalid_json"
    assert [(r.error, r.p) for r in rows] == [
        (None, '{"a":1}'), (None, '{"a":{"b":2}}'), (bad, None), (bad, None), (bad, None), (bad, None), (bad, None), (None, "{}"),
    ]


def test_results_tolerate_drift(spark):
    raw = {
        "broker": 5, "authors": [{"name": " 张三 ", "cert": ""}, {"name": None}, "x"], "publish_date": "2024年3月4日",
        "targets": [{"name": "安洁", "code": "sz002635", "stance": "强推", "has_forecast": True}, {"name": "乙", "code": 600001, "has_forecast": "true"}, {"name": " "}, [1]],
        "themes": {"name": "t"}, "rating": ["x"], "title": None,
    }
    cases = [raw, {"rating": {"action": "强推", "maintained": False}, "targets": None}, {"targets": 5}, {"themes": False, "targets": 0}]
    df = spark.createDataFrame([(i, json.dumps(c, ensure_ascii=False), "代码002635。") for i, c in enumerate(cases)], "i int, raw string, body string")
    rows = extraction.normalize_result(extraction.repair_json(df)).orderBy("i").collect()
    first = rows[0].result
    assert (first.broker, first.title, str(first.publish_date), first.publish_date_source, first.report_type) == ("5", "", "2024-03-04", "llm", "其他")
    assert [(a.name, a.cert) for a in first.authors] == [("张三", None)]
    assert [(t.code, t.name, t.stance, t.has_forecast, t.code_source) for t in first.targets] == [
        ("002635", "安洁", "推荐", True, "text"), ("600001", "乙", "提及", False, "inferred"),
    ]
    assert first.themes == [] and first.rating.action is None and first.rating.maintained is None
    assert rows[1].result.rating.action == "买入" and rows[1].result.rating.maintained is False and rows[1].result.targets == []
    assert rows[2].schema_error == "schema_invalid" and rows[2].result is None
    assert rows[3].schema_error is None


def test_citations(spark):
    raw = {
        "common_conclusions": [{"text": " a ", "report_refs": [3, "1", 2.7, True, "2.7", None, 9, -1, {"x": 1}]}, {"text": "b", "report_refs": []}, {"text": "", "report_refs": [1]}, "c"],
        "consensus_targets": [{"name": "n", "code": "sz000001", "report_refs": [2]}, {"name": "m", "code": "999999", "report_refs": [2]}],
        "divergences": 3,
    }
    df = spark.createDataFrame([(1, json.dumps(raw), 3)], "theme_id int, raw string, n_reports int")
    items = synthesis.cited_items(extraction.repair_json(df))
    codes = spark.createDataFrame([(1, "000001")], "theme_id int, code string")
    rows = synthesis.keep_known_codes(items, codes).orderBy("part", "position").collect()
    assert [(r.part, r.text, r.code, r.refs) for r in rows] == [
        ("common_conclusions", "a", None, [1, 2, 3]), ("consensus_targets", "n", "000001", [2]), ("consensus_targets", "m", None, [2]),
    ]


def test_search_words(spark):
    reports = spark.createDataFrame([(1, "AI 算力 深度"), (2, "存储"), (3, "芯")], "id int, title string")
    bodies = spark.createDataFrame([(2, "算力需求 AI")], "report_id int, body string")
    none = spark.createDataFrame([], "report_id int, summary string")
    index = retrieval.build_postings(reports, bodies, none)
    found = lambda q: sorted(r.report_id for r in retrieval.matching_reports(index, q).collect())
    assert found("算力") == [1, 2] and found("ai 深度") == [1] and found("芯") == [3] and found("算") == [1, 2] and found("算 ai 储") == [2]
    assert retrieval.matching_reports(index, "  ") is None


def test_bucketed_tables_meet_without_exchange(spark, tmp_path):
    from dossier.operators.views import current_links
    from dossier.sources.snapshots import write_bucketed

    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/db'")
    links = spark.range(100).selectExpr("id % 20 AS report_id", "id % 40 AS analysis_id", "id AS theme_id")
    reports = spark.range(20).selectExpr("id", "false AS deleted", "id AS current_analysis_id")
    expected = current_links(links, reports).count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = current_links(
            write_bucketed(links, "bucketed.links", ["report_id", "analysis_id"], 4),
            write_bucketed(reports, "bucketed.reports", ["id", "current_analysis_id"], 4),
        )
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == expected > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_segments_replace_and_merge(spark, tmp_path):
    rng = random.Random(4)
    words = ["ai", "chip", "算力", "bank", "the"]
    bodies = lambda texts: spark.createDataFrame(list(texts.items()), "report_id long, body string")
    none = spark.createDataFrame([], "report_id long, summary string")
    titles = spark.createDataFrame([], "id long, title string")
    held, folder = {}, str(tmp_path / "index")
    for segment in range(4):
        touched = rng.sample(range(12), 6) if segment else list(range(8))
        texts = {i: " ".join(rng.choices(words, k=5)) for i in touched if rng.random() < 0.8}
        held = {i: x for i, x in held.items() if i not in touched} | texts
        rows = spark.createDataFrame([(i,) for i in touched], "report_id long")
        retrieval.add_segment(folder, segment, retrieval.build_postings(titles, bodies(texts), none), rows if segment else None)
        index = retrieval.read_index(spark, folder)
        for asked in (["ai"], ["chip", "the"], ["算力", "bank"]):
            want = {i: sum(x.split().count(w) for w in asked) for i, x in held.items() if all(w in x.split() for w in asked)}
            assert {r.report_id: r.hits for r in retrieval.search(index, " ".join(asked)).collect()} == want
    found = retrieval.search(index, "ai chip")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "token#" in line]
    assert len(scans) == 1 and "In(token, [ai,chip])" in scans[0]
    retrieval.merge_segments(spark, folder, str(tmp_path / "merged"))
    merged = retrieval.read_index(spark, str(tmp_path / "merged"))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(merged) == order(index) and order(retrieval.search(merged, "ai chip")) == order(found)
