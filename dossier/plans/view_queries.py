"""Lists, details, queues, counts and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import normalize_name
from ..operators import coverage, views
from .registry import query
from .standins import ctes

text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

HEADS = "current_links AS (SELECT l.*, r.broker, r.publish_date, r.title FROM links l JOIN reports r ON r.id = l.report_id AND r.current_analysis_id = l.analysis_id WHERE NOT r.deleted)"
MEMBERS = "members AS (SELECT theme_id, target_code, min(linked_on) AS joined_at, max(CASE WHEN stance = '推荐' THEN 1 ELSE 0 END) = 1 AS is_active, CASE WHEN max(line_no) > 6 THEN 'manual' WHEN max(line_no) > 3 THEN 'analysis' ELSE 'seed' END AS source FROM links GROUP BY theme_id, target_code)"
MASTER = "master AS (SELECT code AS target_code, code, name, upper(name) AS name_norm, n_name AS industry, 'SZ' AS exchange FROM targets JOIN nation ON n_nationkey = l2_key)"


def members(t):
    return t.links.groupBy("theme_id", "target_code").agg(
        F.min("linked_on").alias("joined_at"),
        (F.max(F.when(F.col("stance") == "推荐", 1).otherwise(0)) == 1).alias("is_active"),
        F.expr("CASE WHEN max(line_no) > 6 THEN 'manual' WHEN max(line_no) > 3 THEN 'analysis' ELSE 'seed' END").alias("source"),
    )


def master(t):
    return (
        t.targets.join(t.raw("nation"), F.expr("n_nationkey = l2_key"))
        .select(
            F.col("code").alias("target_code"),
            "code",
            "name",
            normalize_name(F.col("name")).alias("name_norm"),
            F.col("n_name").alias("industry"),
            fields.exchange_of(F.col("code")).alias("exchange"),
        )
    )


@query(
    "f1_report_list",
    ctes("reports", "links")
    + f""", {HEADS} SELECT id, title, broker, CAST(publish_date AS VARCHAR) AS publish_date, count(*) OVER () AS total FROM reports r
      WHERE NOT deleted AND broker = 'Broker 3' AND publish_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
      AND EXISTS (SELECT 1 FROM current_links c JOIN part ON p_partkey = c.theme_id WHERE c.report_id = r.id AND p_type = 'PROMO')
      ORDER BY r.publish_date DESC, id DESC LIMIT 20 OFFSET 20""",
)
def report_list(t):
    themes = t.raw("part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("theme_id"))
    theme_links = views.current_links(t.links.join(themes, "theme_id", "left_semi"), t.reports)
    rows = views.report_list(
        t.reports, broker="Broker 3", date_from="1996-01-01", date_to="2000-12-31", theme_links=theme_links
    )
    total = rows.agg(F.count("*")).scalar()
    shown = views.page(rows.select("id", "title", "broker", "publish_date"), views.newest_first(), 20, 20, 100)
    return shown.withColumn("total", total).withColumn("publish_date", F.col("publish_date").cast("string"))


_FILES = "files AS (SELECT conv_id AS report_id, turn AS file_id, CASE WHEN role <> 'system' THEN length(text) % 7 END AS converted_at, text FROM conversations)"


def _files(t):
    return t.raw("conversations").selectExpr(
        "conv_id AS report_id", "turn AS file_id", "CASE WHEN role <> 'system' THEN length(text) % 7 END AS converted_at", "text"
    )


@query(
    "f2_current_body",
    f"WITH {_FILES} SELECT report_id, file_id, md5(text) AS body_md5 FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY converted_at DESC, file_id DESC) AS rn FROM files WHERE converted_at IS NOT NULL) WHERE rn = 1",
)
def current_body(t):
    return views.current_bodies(_files(t)).select(
        "report_id", "file_id", F.md5(F.col("text").cast("binary")).alias("body_md5")
    )


@query("f3_latest_upload", f"WITH {_FILES} SELECT report_id, max(file_id) AS file_id FROM files GROUP BY report_id")
def latest_upload(t):
    return views.latest_uploads(_files(t))


@query(
    "f4_current_projection",
    ctes("reports", "links") + f", {HEADS} SELECT report_id, theme_id, target_code, stance, broker FROM current_links",
)
def current_projection(t):
    return views.current_links(t.links, t.reports, "broker").select("report_id", "theme_id", "target_code", "stance", "broker")


_MATCHES = "matches AS (SELECT doc_id AS match_id, doc_id AS report_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'pending' WHEN toxic = 1 THEN 'dismissed' ELSE 'confirmed' END AS status FROM labels)"


def _matches(t):
    return t.raw("labels").selectExpr(
        "doc_id AS match_id",
        "doc_id AS report_id",
        "CASE WHEN quality = 1 AND toxic = 0 THEN 'pending' WHEN toxic = 1 THEN 'dismissed' ELSE 'confirmed' END AS status",
    )


@query(
    "f5_report_targets",
    ctes("reports", "links", "targets")
    + f""", {HEADS}, {MASTER}, {_MATCHES} SELECT c.report_id, c.line_no, c.target_code, coalesce(m.name, '') AS target_name, coalesce(m.industry, '') AS industry,
     c.stance, coalesce(q.status, '') AS match_status FROM current_links c LEFT JOIN master m ON m.target_code = c.target_code LEFT JOIN matches q ON q.match_id = c.theme_id""",
)
def report_targets(t):
    links = t.links.withColumn("match_id", F.col("theme_id"))
    joined = views.report_targets(
        links, t.reports, master(t).select("target_code", F.col("name").alias("target_name"), "industry"),
        _matches(t).select("match_id", F.col("status").alias("match_status")),
    )
    return joined.select("report_id", "line_no", "target_code", text("target_name"), text("industry"), "stance", text("match_status"))


@query(
    "f6_target_search",
    ctes("targets") + f", {MASTER} SELECT code, name, exchange, industry FROM master WHERE (starts_with(code, '9') OR contains(name, '9') OR contains(name_norm, '9')) AND name <> '' ORDER BY code LIMIT 15",
)
def target_search(t):
    return views.target_search(master(t), "9", 15).select("code", "name", "exchange", "industry")


@query(
    "f7_theme_reports",
    ctes("reports", "links") + f", {HEADS} SELECT DISTINCT theme_id, report_id, title, broker, CAST(publish_date AS VARCHAR) AS publish_date FROM current_links",
)
def theme_reports(t):
    return views.theme_reports(t.links, t.reports, "title", "broker", "publish_date").withColumn("publish_date", F.col("publish_date").cast("string"))


@query(
    "f8_theme_members",
    ctes("links", "targets") + f", {MEMBERS}, {MASTER} SELECT theme_id, target_code, name, industry, source, CAST(joined_at AS VARCHAR) AS joined_at FROM members JOIN master USING (target_code) WHERE is_active",
)
def theme_members(t):
    return views.theme_members(members(t), master(t), active_only=True).select(
        "theme_id", "target_code", "name", "industry", "source", text("joined_at")
    )


_COUNTS = """rc AS (SELECT theme_id, count(DISTINCT report_id) AS report_count FROM current_links GROUP BY theme_id),
 mc AS (SELECT theme_id, count(*) AS member_count FROM members WHERE is_active GROUP BY theme_id)"""


@query(
    "f9_theme_list",
    ctes("reports", "links", "themes")
    + f""", {HEADS}, {MEMBERS}, {_COUNTS} SELECT id, name, coalesce(report_count, 0) AS report_count, coalesce(member_count, 0) AS member_count
    FROM themes LEFT JOIN rc ON rc.theme_id = id LEFT JOIN mc ON mc.theme_id = id
    WHERE status = 'active' AND contains(lower(replace(name, ' ', '') || synonym), 'redring') ORDER BY coalesce(report_count, 0) DESC, id LIMIT 50""",
)
def theme_list(t):
    themes = t.themes.withColumn("synonyms", F.array("synonym"))
    rows = views.theme_list(
        themes, coverage.reports_per_theme(t.links, t.reports), coverage.active_members(members(t)), needle="Red Ring"
    )
    return views.page(rows, [F.desc("report_count"), F.col("id")], 50, 0, 200).select("id", "name", "report_count", "member_count")


@query(
    "f10_pending_queue",
    ctes("bodies") + f", {_MATCHES} SELECT match_id, report_id, title FROM matches JOIN bodies ON doc_id = report_id WHERE status = 'pending'",
)
def pending_queue(t):
    reports = t.bodies.select(F.col("doc_id").alias("id"), "title")
    queue = views.pending_queue(_matches(t).withColumn("created_at", F.col("report_id")), reports)
    return queue.select("match_id", "report_id", "title")


@query(
    "f11_version_history",
    ctes("versions", "reports") + " SELECT v.report_id, version, model, version = current_analysis_id % 3 AS is_head FROM versions v JOIN reports r ON r.id = v.report_id WHERE NOT deleted AND current_analysis_id IS NOT NULL",
)
def version_history(t):
    versions = t.versions.withColumn("analysis_id", F.col("version"))
    reports = t.reports.where("current_analysis_id IS NOT NULL").withColumn("current_analysis_id", F.col("current_analysis_id") % 3)
    return views.version_history(versions, reports).select("report_id", "version", "model", "is_head")


@query(
    "f12_owner_scoping",
    ctes("log", "reports") + " SELECT event_id, subscription_id, event FROM log WHERE event = 'view' AND subscription_id IN (SELECT id FROM reports WHERE created_by < 300 AND broker = 'Broker 7')",
)
def owner_scoping(t):
    subscriptions = t.reports.selectExpr(
        "id AS subscription_id", "CASE WHEN created_by < 300 AND broker = 'Broker 7' THEN 7 ELSE 0 END AS created_by"
    )
    refs = t.log.withColumn("status", F.col("event"))
    return views.visible_references(refs, subscriptions, user=7, status="view").select("event_id", "subscription_id", "event")


@query(
    "f13_run_log",
    ctes("log") + " SELECT event_id, subscription_id, CAST(day AS VARCHAR) AS day, count(*) OVER () AS total FROM log WHERE event = 'error' ORDER BY event_id DESC LIMIT 50 OFFSET 10",
)
def run_log(t):
    rows = views.run_log(t.log, event="error")
    shown = views.page(rows.select("event_id", "subscription_id", "day"), [F.desc("event_id")], 50, 10, 200)
    return shown.withColumn("total", rows.agg(F.count("*")).scalar()).withColumn("day", F.col("day").cast("string"))


@query(
    "f14_due_subscriptions",
    ctes("log") + " SELECT subscription_id, CAST(max(day) AS VARCHAR) AS next_run FROM log GROUP BY subscription_id HAVING count_if(event = 'purchase') > 0 AND max(seen_at) <= TIMESTAMP '2024-01-30 18:00:00'",
)
def due_subscriptions(t):
    subscriptions = t.log.groupBy("subscription_id").agg(
        (F.count_if(F.col("event") == "purchase") > 0).alias("enabled"), F.max("seen_at").alias("next_run_at"), F.max("day").cast("string").alias("next_run")
    )
    now = F.lit("2024-01-30 18:00:00").cast("timestamp_ntz")
    return views.due_subscriptions(subscriptions, now).select("subscription_id", "next_run")


@query(
    "f15_subscription_theme",
    "SELECT c_custkey AS subscription_id, coalesce(n_name, '#' || CAST(c_nationkey * 2 AS VARCHAR)) AS theme_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey * 2",
)
def subscription_theme(t):
    subscriptions = t.raw("customer").selectExpr("c_custkey AS subscription_id", "c_nationkey * 2 AS theme_id")
    themes = t.raw("nation").selectExpr("n_nationkey AS id", "n_name AS name")
    return views.subscriptions_with_theme(subscriptions, themes).select("subscription_id", "theme_name")


@query(
    "f16_reading_link",
    "SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'https://reports.example.org/view?id=' || CAST(page_id AS VARCHAR) ELSE '' END AS report_url FROM pages",
)
def reading_link(t):
    templates = {"https": "https://reports.example.org/view?id="}
    scheme = F.regexp_extract("url", "^([a-z]+):", 1)
    link = fields.view_url(scheme, F.col("page_id").cast("string"), templates)
    return t.raw("pages").select("page_id", F.coalesce(link, F.lit("")).alias("report_url"))


@query(
    "f17_theme_detail",
    ctes("reports", "links", "themes", "versions")
    + f""", {HEADS}, {MEMBERS}, {_COUNTS}, syn AS (SELECT report_id AS theme_id, max(version) AS version FROM versions GROUP BY report_id)
    SELECT id, name, status, coalesce(report_count, 0) AS report_count, coalesce(member_count, 0) AS member_count, coalesce(syn.version, -1) AS version
    FROM themes LEFT JOIN rc ON rc.theme_id = id LEFT JOIN mc ON mc.theme_id = id LEFT JOIN syn ON syn.theme_id = id""",
)
def theme_detail(t):
    themes = t.themes.withColumn("synonyms", F.array("synonym"))
    syntheses = t.versions.selectExpr("report_id AS theme_id", "report_id * 100 + version AS synthesis_id", "version", "model AS created_at")
    detail = views.theme_detail(
        themes, coverage.reports_per_theme(t.links, t.reports), coverage.active_members(members(t)), syntheses
    )
    return detail.select("id", "name", "status", "report_count", "member_count", F.coalesce("version", F.lit(-1)).alias("version"))


_TAGS = "tag_links AS (SELECT report_id, code_no AS tag_id, min(linked_on) AS created_at FROM links GROUP BY report_id, code_no), placed AS (SELECT report_id, tag_id, row_number() OVER (PARTITION BY report_id ORDER BY created_at, tag_id) AS position FROM tag_links)"


def _tags(t):
    links = t.links.groupBy("report_id", F.col("code_no").alias("tag_id")).agg(F.min("linked_on").alias("created_at"))
    return coverage.tags_in_order(links)


@query("d8_tags_in_order", ctes("links") + f", {_TAGS} SELECT report_id, tag_id, position FROM placed")
def tags_in_order(t):
    return _tags(t).select("report_id", "tag_id", "position")


@query(
    "f18_report_detail",
    ctes("reports", "links")
    + f""", {_TAGS}, {_FILES} SELECT id, 'report' AS part, 0 AS position, title AS value FROM reports WHERE NOT deleted
    UNION ALL SELECT id, 'file', file_id, 'f' || CAST(file_id AS VARCHAR) FROM reports JOIN files ON report_id = id WHERE NOT deleted
    UNION ALL SELECT id, 'tag', position, 't' || CAST(tag_id AS VARCHAR) FROM reports JOIN placed ON report_id = id WHERE NOT deleted""",
)
def report_detail(t):
    files = _files(t).withColumn("filename", F.expr("'f' || file_id"))
    tags = _tags(t).withColumn("tag", F.expr("'t' || tag_id"))
    return views.report_detail(t.reports, files, tags).select("id", "part", "position", "value")


@query(
    "a1_reports_per_theme",
    ctes("reports", "links", "themes")
    + f", {HEADS} SELECT theme_id, name, count(DISTINCT report_id) AS report_count FROM current_links JOIN themes ON id = theme_id GROUP BY theme_id, name",
)
def reports_per_theme(t):
    counts = coverage.reports_per_theme(t.links, t.reports)
    return counts.join(t.themes.select(F.col("id").alias("theme_id"), "name"), "theme_id")


@query(
    "a2_active_members",
    ctes("links") + f", {MEMBERS} SELECT theme_id, count(*) AS member_count FROM members WHERE is_active GROUP BY theme_id",
)
def active_members(t):
    return coverage.active_members(members(t))


AUTHORS = "signed AS (SELECT r.id AS report_id, r.current_analysis_id AS analysis_id, a.name, a.cert, r.broker, r.deleted FROM reports r JOIN authors a ON a.id = r.author_id)"


def signed(t):
    names = t.authors.select(F.col("id").alias("author_id"), "name", "cert")
    return t.reports.select(F.col("id").alias("report_id"), F.col("current_analysis_id").alias("analysis_id"), "author_id").join(names, "author_id").drop("author_id")


@query(
    "a3_author_search",
    ctes("reports", "authors")
    + f""", {AUTHORS} SELECT name, coalesce(cert, '') AS cert, broker, count(DISTINCT report_id) AS report_count FROM signed
    WHERE NOT deleted AND analysis_id IS NOT NULL AND contains(name, '00') GROUP BY ALL ORDER BY report_count DESC, name, cert, broker LIMIT 20""",
)
def author_search(t):
    return coverage.author_search(signed(t), t.reports, "00").withColumn("cert", F.coalesce("cert", F.lit("")))


_NAME = "Customer#000000010"
_OWN = f"own AS (SELECT DISTINCT report_id FROM signed WHERE NOT deleted AND analysis_id IS NOT NULL AND name = '{_NAME}' AND broker = 'Broker 0')"


@query(
    "a4_theme_coverage",
    ctes("reports", "authors", "links", "themes")
    + f""", {AUTHORS}, {HEADS}, {_OWN} SELECT DISTINCT c.theme_id, coalesce(t.name, '') AS name, coalesce(t.status, '') AS status, c.report_id,
    (SELECT count(DISTINCT d.report_id) FROM current_links d JOIN own o ON o.report_id = d.report_id WHERE d.theme_id = c.theme_id) AS reports
    FROM current_links c JOIN own USING (report_id) LEFT JOIN themes t ON t.id = c.theme_id""",
)
def theme_coverage(t):
    own = coverage.author_reports(signed(t), t.reports, _NAME, broker="Broker 0")
    pairs = coverage.coverage(t.links, t.reports, own, "theme_id")
    themes = t.themes.select(F.col("id").alias("theme_id"), "name", "status")
    return pairs.join(themes, "theme_id", "left").select("theme_id", text("name"), text("status"), "report_id", "reports")


@query(
    "a5_target_coverage",
    ctes("reports", "authors", "links", "targets")
    + f""", {AUTHORS}, {HEADS}, {_OWN} SELECT DISTINCT c.target_code, t.name, c.report_id,
    (SELECT count(DISTINCT d.report_id) FROM current_links d JOIN own o ON o.report_id = d.report_id WHERE d.target_code = c.target_code) AS reports
    FROM current_links c JOIN own USING (report_id) JOIN targets t ON t.code = c.target_code""",
)
def target_coverage(t):
    own = coverage.author_reports(signed(t), t.reports, _NAME, broker="Broker 0")
    pairs = coverage.coverage(t.links, t.reports, own, "target_code")
    names = t.targets.select(F.col("code").alias("target_code"), "name")
    return pairs.join(names, "target_code").select("target_code", "name", "report_id", "reports")


@query(
    "a6_download_quota",
    ctes("log")
    + """ SELECT CAST(coalesce(sum(k) FILTER (seen_at >= TIMESTAMP '2024-01-20'), 0) AS BIGINT) AS downloads_today, CAST(coalesce(sum(k), 0) AS BIGINT) AS downloads_total
    FROM log WHERE event IN ('view', 'click')""",
)
def download_quota(t):
    stats = F.expr(
        "CASE event WHEN 'view' THEN '{\"downloaded\":' || k || '}' WHEN 'click' THEN '{\"found\":1,\"downloaded\":' || k || '}' WHEN 'error' THEN '{\"consecutive_failures\":2}' END"
    )
    log = t.log.select("seen_at", stats.alias("stats"))
    return coverage.downloads(log, F.lit("2024-01-20").cast("timestamp_ntz"))
