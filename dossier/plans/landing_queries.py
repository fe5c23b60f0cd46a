"""Landing of files, master lists, snapshots and saved responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import shared_folder
from ..sources import connector, files, master, snapshots
from .registry import query
from .standins import ctes


@query(
    "s1_file_landing",
    """SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.' || ext AS filename, octet_length(encode(text)) AS size_bytes,
        CASE WHEN ext IN ('pdf', 'DOCX') THEN sha256(text) ELSE '' END AS sha256,
        CASE WHEN ext IN ('pdf', 'DOCX') THEN '' ELSE 'unsupported_format' END AS reject_reason
       FROM (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'pdf' WHEN 'de' THEN 'DOCX' ELSE 'txt' END AS ext FROM documents)""",
)
def file_landing(t):
    path = F.expr(
        "'in/' || source || '/doc_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'pdf' WHEN 'de' THEN 'DOCX' ELSE 'txt' END"
    )
    content = F.col("text").cast("binary")
    landed = files.land_files(
        t.raw("documents").select(
            "doc_id", path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("length")
        )
    )
    return landed.select(
        "doc_id",
        "filename",
        "size_bytes",
        F.coalesce("sha256", F.lit("")).alias("sha256"),
        F.coalesce("reject_reason", F.lit("")).alias("reject_reason"),
    )


@query(
    "s2_master_list",
    "SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code, p_name AS name FROM part WHERE p_type <> 'PROMO'",
)
def master_list(t):
    listed = t.raw("part").selectExpr(
        "CASE WHEN p_type = 'PROMO' THEN 'x' || p_partkey ELSE lpad(CAST(p_partkey AS STRING), 6, '0') END AS code",
        "p_name AS name",
    )
    return master.clean_master_list(listed)


INDUSTRY = """SELECT lpad(CAST(r_regionkey AS VARCHAR(9)), 2, '0') AS l1_code, r_name AS l1_name,
  lpad(CAST(r_regionkey AS VARCHAR(9)), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR(9)), 2, '0') AS l2_code, n_name AS l2_name,
  lpad(CAST(r_regionkey AS VARCHAR(9)), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR(9)), 2, '0') || '01' AS l3_code,
  n_name || ' I' AS l3_name FROM nation JOIN region ON n_regionkey = r_regionkey"""


def industry_names(t):
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    joined = t.raw("nation").join(t.raw("region"), F.expr("n_regionkey = r_regionkey"))
    l2 = F.concat(two("r_regionkey"), two("n_nationkey"))
    return joined.select(
        two("r_regionkey").alias("l1_code"),
        F.col("r_name").alias("l1_name"),
        l2.alias("l2_code"),
        F.col("n_name").alias("l2_name"),
        F.concat(l2, F.lit("01")).alias("l3_code"),
        F.concat("n_name", F.lit(" I")).alias("l3_name"),
    )


@query("s3_industry_names", INDUSTRY)
def industry_table(t):
    """Written as the CSV code table, then scanned with its schema."""
    folder = shared_folder(t.spark, "industry")
    industry_names(t).write.option("header", True).csv(folder)
    return master.read_industry_names(t.spark, folder)


@query(
    "s4_concept_snapshot",
    """SELECT 'BK' || CAST(p_partkey AS VARCHAR) AS seed_code, p_name AS name,
        lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS member FROM part WHERE p_type <> 'PROMO'""",
)
def concept_snapshot(t):
    """Written as snapshot JSON, one board per line file record, then scanned."""
    folder = shared_folder(t.spark, "concepts")
    board = F.struct(
        F.expr("'BK' || p_partkey").alias("code"),
        F.expr("CASE WHEN p_type = 'PROMO' THEN p_name || '涨停' ELSE ' ' || p_name END").alias("name"),
        F.expr("array(lpad(CAST(p_partkey AS STRING), 6, '0'), 'bad', '12345')").alias("members"),
    )
    t.raw("part").select(F.array(board).alias("concepts")).write.json(folder)
    seeds = master.concept_seeds(t.spark.read.schema(master.SNAPSHOT_SCHEMA).json(folder))
    return seeds.select("seed_code", "name", F.explode("members").alias("member"))


@query(
    "s5_snapshot_merge",
    ctes("themes")
    + """ SELECT seed_code AS code, name, status <> 'active' AS stale,
          CASE WHEN status = 'active' THEN 'new ' ELSE 'old ' END || synonym AS member
          FROM themes WHERE status = 'active' OR source = 'seed_em'""",
)
def snapshot_merge(t):
    fetched = t.themes.where("status = 'active'").selectExpr(
        "seed_code AS code", "array('new ' || synonym) AS members"
    )
    previous = t.themes.where("source = 'seed_em'").selectExpr(
        "seed_code AS code", "array('old ' || synonym) AS members"
    )
    boards = t.themes.selectExpr("seed_code AS code", "name")
    merged = master.merge_snapshot(boards, fetched, previous)
    return merged.select("code", "name", "stale", F.explode("members").alias("member"))


_RESPONSE = r"""'{"code":0,"data":[{"reportId":' || event_id || ',"title":"<em>' || event || '</em> r' || k || ' ","orgName":" <EM>Desk ' ||
 subscription_id || '</EM>","industryName":"","pageNum":' || (k - 10) || ',' ||
 CASE WHEN event = 'view' THEN '"pubTimeStr":"on 2024-1-' || (k % 31 + 1) || '"'
      WHEN event = 'error' THEN '"pubTime":' || (unix_seconds(CAST(seen_at AS TIMESTAMP)) * 1000)
      ELSE '"pubTime":' || unix_seconds(CAST(seen_at AS TIMESTAMP)) END ||
 ',"paragraphs":[{"content":"<em>a</em>' || k || ' "},{"content":""},7,{"pageNum":3},{"content":"b"}]},' ||
 '{"reportId":"","title":"no id","pubTime":1},5,{"reportId":"y' || event_id || '","title":"t","pubTimeStr":"2024-13-1"}]}'"""


@query(
    "s6_search_references",
    ctes("log")
    + """ SELECT event_id, CAST(event_id AS VARCHAR) AS external_id, event || ' r' || CAST(k AS VARCHAR) AS title,
      CASE WHEN event = 'view' THEN '2024-01-' || lpad(CAST(k % 31 + 1 AS VARCHAR), 2, '0') ELSE CAST(day AS VARCHAR) END AS publish_date,
      CASE WHEN event = 'view' THEN '' ELSE strftime(seen_at, '%Y-%m-%d %H:%M:%S') END AS published_at,
      'Desk ' || CAST(subscription_id AS VARCHAR) AS broker, '' AS industry,
      CASE WHEN k > 10 THEN k - 10 ELSE -1 END AS pages, 'a' || CAST(k AS VARCHAR) || chr(10) || 'b' AS snippet FROM log""",
)
def search_references(t):
    responses = t.spread(t.log).select("event_id", F.expr(_RESPONSE).alias("payload"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return connector.search_references(responses).select(
        "event_id",
        "external_id",
        "title",
        text("publish_date"),
        text("published_at"),
        text("broker"),
        text("industry"),
        F.coalesce("pages", F.lit(-1)).alias("pages"),
        text("snippet"),
    )


@query(
    "s7_download_url",
    """SELECT page_id, CASE WHEN page_id % 5 = 4 THEN '' ELSE url END AS download_url FROM pages""",
)
def download_url(t):
    payload = F.expr(
        """CASE page_id % 5 WHEN 0 THEN '{"data":" ' || url || ' ","url":"no"}'
           WHEN 1 THEN '{"data":{"url":"no"},"fileurl":"' || url || '"}'
           WHEN 2 THEN '{"data":{"pdfurl":7,"url":" ","downloadurl":"' || url || '"}}'
           WHEN 3 THEN '{"data":"","pdfurl":"' || url || '"}' ELSE '{"data":{"page":1}}' END"""
    )
    return t.raw("pages").select(
        "page_id", F.coalesce(connector.download_url(payload), F.lit("")).alias("download_url")
    )


_SITE = r"regexp_extract(url, '//([^/?#]*)', 1)"
_PAGE_TEXT = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(
    "s8_scanned_gate",
    f"""SELECT file_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS chars,
        CASE WHEN sum(length(text)) / count(*) < 30 THEN 'scanned' ELSE '' END AS reject_reason
        FROM (SELECT {_SITE} AS file_id, {_PAGE_TEXT} AS text FROM pages) GROUP BY file_id""",
)
def scanned_gate(t):
    pages = t.raw("pages").selectExpr(f"{_SITE} AS file_id", f"{_PAGE_TEXT} AS text")
    return files.scanned_gate(pages).withColumn(
        "reject_reason", F.coalesce("reject_reason", F.lit(""))
    )


@query(
    "s9_output_gate",
    """SELECT source, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 200 THEN 'empty_output' ELSE '' END AS error_code,
        count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars_raw FROM documents GROUP BY ALL""",
)
def output_gate(t):
    gated = files.converted_bodies(t.spread(t.raw("documents")), "text")
    return gated.groupBy("source", F.coalesce("error_code", F.lit("")).alias("error_code")).agg(
        F.count("*").alias("n"), F.sum("chars_raw").alias("chars_raw")
    )


@query(
    "s10_versioned_snapshot",
    ctes("versions")
    + """ SELECT report_id, version, md5(result_text) AS body_md5 FROM versions v
          WHERE version = (SELECT max(version) FROM versions w WHERE w.report_id = v.report_id)""",
)
def versioned_snapshot(t):
    folder = snapshots.write_snapshot(t.versions, shared_folder(t.spark, "analyses"))
    head = snapshots.read_head(t.spark, folder, "report_id", "version")
    return head.select(
        "report_id", "version", F.md5(F.col("result_text").cast("binary")).alias("body_md5")
    )
