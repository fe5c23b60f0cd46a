"""Text rules over the corpus: normalisers, cleaning, chunks, outline, dates, codes, URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning, fields, text
from .registry import query
from .standins import ctes


@query(
    "n1_normalize_title",
    ctes("bodies") + r" SELECT doc_id, regexp_replace(replace(lower(title), 'ß', 'ss'), '\s+', '', 'g') AS title_norm FROM bodies",
)
def normalize_title(t):
    return t.bodies.select("doc_id", text.normalize_title(F.col("title")).alias("title_norm"))


@query(
    "n2_normalize_theme_name",
    ctes("themes") + r" SELECT id, regexp_replace(name, '\s+', '', 'g') AS name_norm FROM themes",
)
def normalize_theme_name(t):
    return t.themes.select("id", text.normalize_theme_name(F.col("name")).alias("name_norm"))


_COMPANIES = """
SELECT c_custkey AS id, c_acctbal AS balance, c_name AS plain,
  CASE WHEN c_acctbal < 0 THEN '*ST ' WHEN c_acctbal < 2000 THEN 'ST' ELSE '' END || c_name ||
  CASE WHEN c_mktsegment = 'BUILDING' THEN '股份有限公司' WHEN c_mktsegment = 'MACHINERY' THEN '集团有限公司'
       WHEN c_mktsegment = 'FURNITURE' THEN ' 控股集团' ELSE '' END AS name
FROM {customer}
UNION ALL
SELECT -1 - s_suppkey, s_acctbal, s_name,
  CASE WHEN s_acctbal < 2000 THEN 'S*ST' ELSE '' END || s_name || CASE WHEN s_acctbal > 5000 THEN '有限公司' ELSE '公司' END
FROM {supplier}
"""


@query(
    "n3_normalize_company_name",
    f"SELECT id, upper(plain) AS name_norm FROM ({_COMPANIES.format(customer='customer', supplier='supplier')})",
)
def normalize_company_name(t):
    companies = t.spark.sql(_COMPANIES, customer=t.raw("customer"), supplier=t.raw("supplier"))
    return companies.select(
        "id", text.normalize_name(F.col("name")).alias("name_norm")
    )


@query(
    "n4_normalize_tag_name",
    ctes("bodies")
    + r" SELECT doc_id, trim(regexp_replace(' ' || title || chr(9) || ' ' || lang || chr(10), '\s+', ' ', 'g')) AS tag FROM bodies",
)
def normalize_tag_name(t):
    raw = F.concat(F.lit(" "), "title", F.lit("\t "), "lang", F.lit("\n"))
    return t.bodies.select("doc_id", text.normalize_tag_name(raw).alias("tag"))


# Report bodies as the PDF engine would hand them over: noise around every whole text.
_NOISY = (
    "'<!-- Start of picture text -->' || chr(10) || '10 20 30' || chr(10) || '<!-- End of picture text -->' || chr(10) || "
    "'- ' || CAST(doc_id AS VARCHAR(20)) || ' -' || chr(10) || '<mark>' || broker || '</mark> [Table_Title]' || chr(10) || "
    "body || chr(10) || '12.5% 13.0%' || chr(10) || '|---|---|' || chr(10) || '' || chr(10) || "
    "'资料来源：' || broker || chr(10) || '图 1：' || lang || chr(10) || '2024年1月' || chr(10) || "
    "'  请务必阅读正文之后的免责条款部分  ' || chr(10) || 'end of ' || CAST(doc_id AS VARCHAR(20))"
)


@query(
    "n5_clean_markdown",
    ctes("bodies")
    + rf""", noisy AS (SELECT doc_id, {_NOISY} AS md FROM bodies),
    stripped AS (SELECT doc_id, replace(replace(regexp_replace(regexp_replace(md,
        '(?s)<!--\s*Start of picture text\s*-->.*?<!--\s*End of picture text\s*-->\n?', '', 'g'),
        '\s*\[Table_\w+\]', '', 'g'), '<mark>', ''), '</mark>', '') AS md FROM noisy),
    listed AS (SELECT doc_id, list_filter(regexp_split_to_array(md, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
        lambda x: NOT regexp_matches(trim(x, ' ' || chr(9)), '请务必阅读正文之后的免责条款部分|^[-—]*\s*\d+\s*[-—]*$|^资料来源[:：].*$|^图\s*[:：]?.{{0,40}}$|^\(?\d{{4}}[ /年]\d{{1,2}}[ /月]\d{{1,2}}[日)]?.{{0,10}}$')
        AND NOT (regexp_full_match(trim(x, ' ' || chr(9)), '[\d\s%.\-]+') AND length(trim(x, ' ' || chr(9))) < 20)) AS kept FROM stripped)
    SELECT doc_id, length(array_to_string(kept, chr(10))) AS n_chars, md5(array_to_string(kept, chr(10))) AS body_md5 FROM listed""",
)
def clean_markdown(t):
    cleaned = cleaning.clean_markdown(F.expr(_NOISY))
    return t.spread(t.bodies).select("doc_id", cleaned.alias("body")).select(
        "doc_id",
        F.length("body").cast("long").alias("n_chars"),
        F.md5(F.col("body").cast("binary")).alias("body_md5"),
    )


# The head of a report names its date in one of several ways, chosen by the order's attributes.
_DATED_HEAD = (
    "CASE WHEN o_orderpriority = '1-URGENT' THEN '日期 ' || y || ' 年 ' || m || '月 ' || d || '日' "
    "WHEN o_orderpriority = '2-HIGH' THEN 'published ' || y || '-' || m || '-' || d || ' by desk' "
    "WHEN o_orderpriority = '3-MEDIUM' THEN y || '/1/2 ' || y || '/5/2 ' || y || '/8/31' || chr(10) || 'as of ' || y || '.' || m || '.' || d "
    "WHEN o_orderstatus = 'P' THEN y || '年13月1日' || chr(10) || 'x' || y || '-2-30' || chr(10) || 'y ' || y || '/' || m || '/' || d "
    "ELSE 'no ' || y || '-' || m || '-' || d || '-1 date' END"
)
_DATE_PARTS = (
    "CAST(extract(year FROM o_orderdate) AS VARCHAR(4)) AS y, CAST(extract(month FROM o_orderdate) AS VARCHAR(2)) AS m, "
    "CAST(extract(day FROM o_orderdate) AS VARCHAR(2)) AS d"
)


@query(
    "n6_anchor_publish_date",
    f"""SELECT o_orderkey,
        CASE WHEN CAST(o_orderdate AS DATE) < DATE '2000-01-01' THEN ''
             WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') OR o_orderstatus = 'P'
             THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE '' END AS anchored
        FROM orders""",
)
def anchor_publish_date(t):
    orders = t.spread(t.raw("orders")).selectExpr("*", *_DATE_PARTS.replace(", CAST", "\nCAST").split("\n"))
    head = F.expr(_DATED_HEAD)
    return orders.select(
        "o_orderkey",
        F.coalesce(fields.anchor_publish_date(head).cast("string"), F.lit("")).alias("anchored"),
    )


@query(
    "n7_normalize_code",
    """SELECT s_suppkey, coalesce(CASE WHEN length(regexp_replace(raw, '[^0-9]', '', 'g')) = 6
          THEN regexp_replace(raw, '[^0-9]', '', 'g') END, '') AS code
       FROM (SELECT s_suppkey, CASE WHEN s_acctbal < 3000 THEN 'SZ' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.X'
             ELSE s_name END AS raw FROM supplier)""",
)
def normalize_code(t):
    raw = F.expr(
        "CASE WHEN s_acctbal < 3000 THEN 'SZ' || lpad(CAST(s_suppkey AS STRING), 6, '0') || '.X' ELSE s_name END"
    )
    return t.raw("supplier").select(
        "s_suppkey", F.coalesce(fields.normalize_code(raw), F.lit("")).alias("code")
    )


_STANCE_WORD = (
    "CASE l_returnflag || l_linestatus WHEN 'AO' THEN '强烈推荐' WHEN 'AF' THEN ' 买入 ' WHEN 'NO' THEN '关注' "
    "WHEN 'NF' THEN '不明' WHEN 'RO' THEN '规避' ELSE '卖出' END"
)


@query(
    "n8_map_stance",
    """SELECT CASE l_returnflag WHEN 'A' THEN '推荐' WHEN 'N' THEN '提及' ELSE '回避' END AS stance,
        count(*) AS n FROM lineitem GROUP BY 1""",
)
def map_stance(t):
    return (
        t.raw("lineitem")
        .groupBy(fields.map_stance(F.expr(_STANCE_WORD)).alias("stance"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "n8_map_action",
    ctes("reports")
    + """ SELECT id, CASE action_word WHEN '强推' THEN '买入' WHEN '增持' THEN '增持' WHEN '持有' THEN '中性'
          WHEN '卖出' THEN '卖出' ELSE '' END AS action FROM reports""",
)
def map_action(t):
    return t.reports.select(
        "id", F.coalesce(fields.map_action(F.col("action_word")), F.lit("")).alias("action")
    )


@query(
    "n9_map_report_type",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '深度' WHEN 'SMALL' THEN '点评' WHEN 'LARGE' THEN '策略'
        WHEN 'PROMO' THEN '策略' WHEN 'STANDARD' THEN '点评' ELSE '其他' END AS report_type FROM part""",
)
def map_report_type(t):
    phrase = F.expr(
        "CASE p_type WHEN 'ECONOMY' THEN p_name || '深度跟踪' WHEN 'SMALL' THEN p_name || '跟踪报告' "
        "WHEN 'LARGE' THEN '宏观' || p_name WHEN 'PROMO' THEN p_name || '行业' "
        "WHEN 'STANDARD' THEN '动态' || p_name || '策略' ELSE p_name END"
    )
    return t.raw("part").select("p_partkey", fields.map_report_type(phrase).alias("report_type"))


@query(
    "n10_exchange_of",
    """SELECT s_suppkey, code, CASE WHEN left(code, 3) IN ('600','601','603','605','688','689') THEN 'SH'
        WHEN left(code, 3) IN ('000','001','002','003','300','301','302') THEN 'SZ'
        WHEN left(code, 2) IN ('43','83','87','88','92') THEN 'BJ' ELSE '' END AS exchange
       FROM (SELECT s_suppkey, lpad(CAST(s_suppkey * 61 * 997 % 1000000 AS VARCHAR), 6, '0') AS code FROM supplier)""",
)
def exchange_of(t):
    coded = t.raw("supplier").selectExpr(
        "s_suppkey", "lpad(CAST(s_suppkey * 61 * 997 % 1000000 AS STRING), 6, '0') AS code"
    )
    return coded.withColumn("exchange", fields.exchange_of(F.col("code")))


_BOARD = (
    "CASE WHEN p_type = 'PROMO' THEN '昨日' || p_name WHEN p_type = 'SMALL' THEN p_name || 'MSCI' "
    "WHEN p_type = 'LARGE' AND p_size < 10 THEN ' 基金 ' WHEN p_type = 'LARGE' THEN '基金' || p_name ELSE p_name END"
)


@query(
    "n11_noise_concept",
    """SELECT p_partkey, p_type IN ('PROMO', 'SMALL') OR (p_type = 'LARGE' AND p_size < 10) AS is_noise FROM part""",
)
def noise_concept(t):
    return t.raw("part").select(
        "p_partkey", fields.is_noise_concept(F.expr(_BOARD)).alias("is_noise")
    )


@query(
    "n12_strip_highlight_and_filename",
    r"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
        coalesce(nullif(regexp_replace(url, '[\\/:*?"<>|\r\n\t]+', '_', 'g'), ''), 'report') AS filename
        FROM pages""",
)
def strip_highlight_and_filename(t):
    raw = F.concat(
        F.lit("  <EM class='k'>"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1),
        F.lit("</em> "),
    )
    return t.raw("pages").select(
        "page_id",
        text.strip_highlight(raw).alias("title"),
        text.safe_filename(F.col("url")).alias("filename"),
    )


@query(
    "n13_chunk_bodies",
    """WITH cut AS (
      SELECT doc_id, 0 AS slot, text AS chunk FROM documents WHERE length(text) <= 2000
      UNION ALL
      SELECT doc_id, CAST(i AS INTEGER), substring(text, CAST(i * 900 + 1 AS BIGINT), 1000)
      FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 900 + 1)) AS i FROM documents WHERE length(text) > 2000))
    SELECT doc_id, slot, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM cut WHERE trim(chunk) <> ''""",
)
def chunk_bodies(t):
    chunks = cleaning.chunk_bodies(
        t.spread(t.raw("documents").select("doc_id", "text")), "text", max_chars=2000, size=1000, overlap=100
    )
    return chunks.select(
        "doc_id",
        "slot",
        F.length("chunk").cast("long").alias("n_chars"),
        F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"),
    )


_OUTLINED = (
    "'# ' || title || ' #' || chr(10) || body || chr(10) || '## Risk *notes*' || chr(10) || '```' || chr(10) || "
    "'# not a heading' || chr(10) || '```' || chr(10) || '####### seven' || chr(10) || '### ' || lang || ' View' || chr(10) || '## Risk notes'"
)


@query(
    "n14_heading_outline",
    ctes("bodies")
    + rf""", lines AS (SELECT doc_id, unnest(regexp_split_to_array({_OUTLINED}, '\r?\n')) AS line,
        unnest(range(len(regexp_split_to_array({_OUTLINED}, '\r?\n')))) AS line_no FROM bodies),
    fenced AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence,
        sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 AS open FROM lines),
    heads AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 1)) AS level,
        trim(regexp_replace(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 2), '[*_`~\[\]]', '', 'g')) AS heading
        FROM fenced WHERE open = 0 AND NOT fence AND regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$')),
    slugged AS (SELECT *, replace(regexp_replace(lower(heading), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\- ]', '', 'g'), ' ', '-') AS base FROM heads),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY line_no) - 1 AS again FROM slugged)
    SELECT doc_id, line_no, level, heading, base || CASE WHEN again > 0 THEN '-' || CAST(again AS VARCHAR) ELSE '' END AS slug FROM numbered""",
)
def heading_outline(t):
    outline = cleaning.heading_outline(
        t.spread(t.bodies).select("doc_id", F.expr(_OUTLINED).alias("md")), "doc_id", "md"
    )
    return outline.withColumn("line_no", F.col("line_no").cast("long")).withColumn(
        "level", F.col("level").cast("long")
    )


_LINK = (
    "CASE WHEN page_id % 8 = 0 THEN 'http://10.' || CAST(page_id % 200 AS VARCHAR(5)) || '.0.1/a' "
    "WHEN page_id % 8 = 1 THEN 'https://100.64.' || CAST(page_id % 200 AS VARCHAR(5)) || '.9:8080/b' "
    "WHEN page_id % 8 = 2 THEN 'ftp' || url WHEN page_id % 8 = 3 THEN 'https:///' || CAST(page_id AS VARCHAR(20)) "
    "WHEN page_id % 8 = 4 THEN 'http://user@172.' || CAST(page_id % 40 AS VARCHAR(5)) || '.3.4?x' "
    "WHEN page_id % 8 = 5 THEN 'http://[fe80::' || CAST(page_id % 9 AS VARCHAR(5)) || ']/z' ELSE url END"
)


@query(
    "n15_url_class",
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'host_not_allowed' WHEN 1 THEN 'ok' WHEN 2 THEN 'scheme_not_allowed'
         WHEN 3 THEN 'no_host' WHEN 4 THEN CASE WHEN page_id % 40 BETWEEN 16 AND 31 THEN 'host_not_allowed' ELSE 'ok' END
         WHEN 5 THEN 'host_not_allowed' ELSE 'ok' END AS url_class FROM pages""",
)
def url_class(t):
    return t.raw("pages").select("page_id", fields.url_class(F.expr(_LINK)).alias("url_class"))
