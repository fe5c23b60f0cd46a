"""Read views that combine several rules, and the key invariants of what jobs produce."""

from pyspark.sql import functions as F

from dossier.operators import identity, retrieval, synthesis, views
from dossier.sources.snapshots import duplicate_keys


def reports(spark):
    return spark.sql(
        "SELECT * FROM VALUES (1, 'AI 算力', 'b', DATE '2024-01-01', false, 11), (2, '存储', 'b', DATE '2024-01-01', false, 12),"
        "(3, 'AI 芯片', 'c', DATE '2024-02-01', false, 13), (4, 'AI 旧', 'b', DATE '2024-03-01', true, 14), (5, 'AI 新', 'b', DATE '2023-01-01', false, NULL)"
        " AS t(id, title, broker, publish_date, deleted, current_analysis_id)"
    )


def test_list_combines_filters_and_clamps_pages(spark):
    rows = reports(spark)
    none = spark.createDataFrame([], "report_id int, body string, summary string")
    index = retrieval.build_postings(rows, none, none)
    found = views.report_list(rows, broker="b", date_from="2023-06-01", matching=retrieval.matching_reports(index, "ai"))
    assert [r.id for r in found.collect()] == [1]
    ids = lambda **kw: [r.id for r in views.page(views.report_list(rows), views.newest_first(), cap=100, **kw).collect()]
    assert ids(limit=0, offset=-5) == [3] and ids(limit=500, offset=0) == [3, 2, 1, 5] and ids(limit=2, offset=1) == [2, 1]


def test_current_links_follow_the_pointer(spark):
    links = spark.createDataFrame([(1, 11, 7), (1, 10, 8), (4, 14, 7), (2, 12, 7), (2, 12, 7), (5, 15, 7)], "report_id int, analysis_id int, theme_id int")
    got = views.theme_reports(links, reports(spark), "title").collect()
    assert sorted((r.theme_id, r.report_id) for r in got) == [(7, 1), (7, 2)]


def test_current_body_and_latest_upload_differ(spark):
    files = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 4), (1, 4, None), (2, 5, None)], "report_id int, file_id int, converted_at int")
    assert [(r.report_id, r.file_id) for r in views.current_bodies(files).collect()] == [(1, 2)]
    assert sorted((r.report_id, r.file_id) for r in views.latest_uploads(files).collect()) == [(1, 4), (2, 5)]


def test_theme_search_ignores_case_width_and_plain_spaces(spark):
    themes = spark.createDataFrame([(1, "ＡＩ 算力", "active", ["x　y"]), (2, "存储", "pending", None)], "id int, name string, status string, synonyms array<string>")
    counts = spark.createDataFrame([], "theme_id int, report_count long")
    members = spark.createDataFrame([], "theme_id int, member_count long")
    find = lambda needle, **kw: [r.id for r in views.theme_list(themes, counts, members, needle=needle, **kw).collect()]
    # spaces inside synonyms stay, so a needle without them does not reach
    assert find("ai算力") == [1] and find("a i 算") == [1] and find("xy") == [] and find("存", status="all") == [2]


def test_evidence_and_fingerprint(spark):
    links = spark.createDataFrame([(1, 11, 7), (2, 12, 7), (3, 13, 7), (3, 13, 7), (4, 14, 7)], "report_id int, analysis_id int, theme_id int")
    evidence = synthesis.select_evidence(links, reports(spark), 2)
    rows = sorted((r.position, r.report_id, r.total, r.truncated) for r in evidence.collect())
    assert rows == [(1, 3, 3, True), (2, 2, 3, True)]
    import hashlib

    assert synthesis.fingerprint(evidence).first().input_fingerprint == hashlib.sha256(b"[2,3]").hexdigest()


def test_deleted_evidence_still_shows(spark):
    syntheses = spark.createDataFrame([(1, [4, 99, 1])], "synthesis_id int, report_ids array<int>")
    got = [(r.position, r.title, r.broker, str(r.publish_date)) for r in synthesis.detail_view(syntheses, reports(spark)).orderBy("position").collect()]
    assert got == [(1, "AI 旧", "b", "2024-03-01"), (2, "#99（已删除）", "", "1970-01-01"), (3, "AI 算力", "b", "2024-01-01")]


def test_identity_stays_unique_and_rerun_changes_nothing(spark):
    day = F.lit("2024-01-01").cast("date")
    files = spark.range(40).select(
        F.col("id").alias("arrival"), F.expr("'T' || id % 7").alias("title"), F.expr("'t' || id % 7").alias("title_norm"), F.lit("b").alias("broker"), day.alias("publish_date")
    )
    live = spark.range(2).select("id", F.expr("'t' || id").alias("title_norm"), F.lit("b").alias("broker"), day.alias("publish_date"))
    merged = identity.merge_identities(files, live, live)
    after = merged.select(F.col("report_id").alias("id"), *identity.IDENTITY).distinct()
    assert duplicate_keys(after, identity.IDENTITY).isEmpty() and duplicate_keys(after, ["id"]).isEmpty()
    again = identity.merge_identities(files, after, after)
    assert sorted((r.arrival, r.report_id) for r in again.collect()) == sorted((r.arrival, r.report_id) for r in merged.collect())
    assert again.where("NOT merged").isEmpty()
