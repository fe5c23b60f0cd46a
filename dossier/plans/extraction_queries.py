"""Extraction landing, versions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import extraction
from .registry import query
from .standins import ctes

text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

_ANSWER = r"""CASE event
 WHEN 'view' THEN '```json' || chr(10) || '{"id":' || event_id || ',"k":"' || k || '"}' || chr(10) || '```'
 WHEN 'click' THEN 'Sure, here it is: {"id":' || event_id || ',"k":"' || k || '"} Done.'
 WHEN 'signup' THEN '[' || event_id || ']'
 WHEN 'error' THEN 'cannot {"id":' || event_id
 ELSE ' {"id":' || event_id || ',"k":' || k || '} ' END"""


@query(
    "x1_repair_json",
    ctes("log")
    + """ SELECT event_id, CASE WHEN event IN ('signup', 'error') THEN 'llm_invalid_json' ELSE '' END AS error,
        CASE WHEN event IN ('signup', 'error') THEN -1 ELSE event_id END AS id,
        CASE WHEN event IN ('signup', 'error') THEN '' ELSE CAST(k AS VARCHAR) END AS k FROM log""",
)
def repair_json(t):
    repaired = extraction.repair_json(t.spread(t.log).select("event_id", F.expr(_ANSWER).alias("raw")))
    return repaired.select(
        "event_id",
        text("error"),
        F.coalesce(F.try_variant_get("payload", "$.id", "bigint"), F.lit(-1)).alias("id"),
        F.coalesce(F.try_variant_get("payload", "$.k", "string"), F.lit("")).alias("k"),
    )


# One saved extraction per report, shaped by the order's attributes.
_SAVED = r"""'{"broker":"' || broker || '","publish_date":' || CASE WHEN deleted THEN 'null' ELSE '"' || publish_date || '"' END ||
 ',"report_type":"公司深度报告","title":7,"summary":"s' || id || '","rating":' || CASE WHEN deleted THEN '"x"' ELSE '{"action":"' || action_word || '","maintained":' ||
 CASE WHEN id % 2 = 0 THEN 'true' ELSE '"true"' END || '}' END ||
 ',"themes":[{"name":" ' || title || ' ","reason":"r"},{"name":""},3],"authors":[{"name":"A' || author_id || '","cert":" "},{"cert":"c"}],' ||
 '"targets":[{"name":"T' || author_id || '","code":"SZ' || lpad(CAST(author_id AS STRING), 6, '0') || '","stance":"增持","has_forecast":true},' ||
 '{"name":"U","code":"99","stance":"?","has_forecast":1},"z",{"name":" "},{"name":"V","code":654321}]}'"""


def _results(t):
    saved = t.spread(t.reports).select(
        "id", F.expr(_SAVED).alias("raw"), F.expr("'code 9' || lpad(CAST(author_id AS STRING), 6, '0') || ' end'").alias("body")
    )
    return extraction.normalize_result(extraction.repair_json(saved))


@query(
    "x2_normalize_result",
    ctes("reports")
    + """ SELECT id, broker, CASE WHEN deleted OR publish_date < DATE '2000-01-01' THEN '' ELSE CAST(publish_date AS VARCHAR) END AS publish_date,
        CASE WHEN deleted OR publish_date < DATE '2000-01-01' THEN '' ELSE 'llm' END AS publish_date_source, '深度' AS report_type, '7' AS title,
        's' || CAST(id AS VARCHAR) AS summary,
        CASE WHEN deleted THEN '' ELSE CASE action_word WHEN '强推' THEN '买入' WHEN '增持' THEN '增持' WHEN '持有' THEN '中性' WHEN '卖出' THEN '卖出' ELSE '' END END AS action,
        CASE WHEN NOT deleted AND id % 2 = 0 THEN 'true' ELSE '' END AS maintained,
        title || '/r' AS themes, 'A' || CAST(author_id AS VARCHAR) || '/-' AS authors,
        'T' || CAST(author_id AS VARCHAR) || ':' || lpad(CAST(author_id AS VARCHAR), 6, '0') || ':推荐:true:text;U:-:提及:false:-;V:654321:提及:false:inferred' AS targets
       FROM reports""",
)
def normalize_result(t):
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return _results(t).select(
        "id",
        "result.broker",
        F.coalesce(F.col("result.publish_date").cast("string"), F.lit("")).alias("publish_date"),
        F.coalesce("result.publish_date_source", F.lit("")).alias("publish_date_source"),
        "result.report_type",
        "result.title",
        "result.summary",
        F.coalesce("result.rating.action", F.lit("")).alias("action"),
        F.coalesce(F.col("result.rating.maintained").cast("string"), F.lit("")).alias("maintained"),
        F.array_join(F.transform("result.themes", lambda e: F.concat_ws("/", e["name"], e["reason"])), ";").alias("themes"),
        F.array_join(F.transform("result.authors", lambda e: F.concat_ws("/", e["name"], dash(e["cert"]))), ";").alias("authors"),
        F.array_join(
            F.transform(
                "result.targets",
                lambda e: F.concat_ws(":", e["name"], dash(e["code"]), e["stance"], e["has_forecast"].cast("string"), dash(e["code_source"])),
            ),
            ";",
        ).alias("targets"),
    )


@query(
    "x3_code_source",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '' WHEN contains(d.text, substring(d.source, 4) || lower(d.lang)) THEN 'text'
        ELSE 'inferred' END AS code_source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def code_source(t):
    """The labelled documents carry a code; it is looked up in the whole body."""
    coded = t.raw("labels").select("doc_id", F.lit(True).alias("labelled"))
    joined = t.spread(t.raw("documents")).join(coded, "doc_id", "left")
    code = F.when(F.col("labelled"), F.concat(F.substring("source", 4, 9), F.lower("lang")))
    return joined.select(
        "doc_id",
        F.coalesce(fields.code_source(code, F.col("text")), F.lit("")).alias("code_source"),
    )


_PRINTED = "CASE WHEN role = 'assistant' THEN 'on 2024年' || (turn % 12 + 1) || '月5日 ' || text ELSE text END"
_WRITTEN = "CASE WHEN turn % 2 = 0 THEN ' 2023.' || (turn % 12 + 1) || '.07 ' WHEN role = 'user' THEN '2023-13-01' ELSE '2023年1月2日x' END"


@query(
    "x4_date_provenance",
    """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '2024-' || lpad(CAST(turn % 12 + 1 AS VARCHAR), 2, '0') || '-05'
         WHEN turn % 2 = 0 THEN '2023-' || lpad(CAST(turn % 12 + 1 AS VARCHAR), 2, '0') || '-07' ELSE '' END AS publish_date,
       CASE WHEN role = 'assistant' THEN 'regex_head' WHEN turn % 2 = 0 THEN 'llm' ELSE '' END AS publish_date_source FROM conversations""",
)
def date_provenance(t):
    dated = t.raw("conversations").select(
        "conv_id",
        "turn",
        fields.anchor_publish_date(F.expr(_PRINTED)).alias("anchored"),
        fields.extracted_date(F.expr(_WRITTEN)).alias("extracted"),
    )
    date, source = fields.date_provenance(F.col("anchored"), F.col("extracted"))
    return dated.select(
        "conv_id",
        "turn",
        F.coalesce(date.cast("string"), F.lit("")).alias("publish_date"),
        F.coalesce(source, F.lit("")).alias("publish_date_source"),
    )


@query(
    "x5_partial_merge",
    ctes("versions")
    + """, firsts AS (SELECT report_id, min(CASE WHEN model <> 'user' THEN version END) AS m FROM versions GROUP BY report_id),
     best AS (SELECT *, row_number() OVER (PARTITION BY report_id, model ORDER BY length(result_text) DESC, version) AS rn FROM versions)
     SELECT b.report_id, coalesce(f.model, '') AS broker, b.model AS name, b.version AS chunk_no, length(b.result_text) AS view_chars
     FROM best b JOIN firsts s ON s.report_id = b.report_id LEFT JOIN versions f ON f.report_id = s.report_id AND f.version = s.m WHERE b.rn = 1""",
)
def partial_merge(t):
    partials = t.versions.select(
        "report_id",
        F.col("version").alias("chunk_no"),
        F.expr("CASE WHEN model <> 'user' THEN model END").alias("broker"),
        F.col("model").alias("name"),
        F.col("result_text").alias("view"),
    )
    scalars = extraction.merge_partials(partials, ["broker"])
    items = extraction.merge_partial_items(partials.drop("broker"), ["name"], "view")
    return items.join(scalars, "report_id").select(
        "report_id", text("broker"), "name", "chunk_no", F.length("view").cast("long").alias("view_chars")
    )


@query(
    "x6_version_append",
    ctes("versions")
    + """, old AS (SELECT report_id, max(version) AS last FROM versions WHERE model = 'user' GROUP BY report_id)
     SELECT v.report_id, v.version AS arrival, coalesce(o.last, 0) + row_number() OVER (PARTITION BY v.report_id ORDER BY v.version) AS version,
       v.version = max(v.version) OVER (PARTITION BY v.report_id) AS is_head
     FROM versions v LEFT JOIN old o ON o.report_id = v.report_id WHERE v.model <> 'user'""",
)
def version_append(t):
    """User turns are the stored versions, the other turns arrive as a batch."""
    heads = t.versions.where("model = 'user'").select("report_id", "version")
    batch = t.versions.where("model <> 'user'").select(
        "report_id", F.col("version").alias("arrival")
    )
    return extraction.append_versions(heads, batch, "report_id", "arrival")


@query(
    "x7_author_projection",
    ctes("reports", "authors")
    + """ SELECT r.id AS report_id, 0 AS seq, a.name, coalesce(a.cert, '') AS cert FROM reports r JOIN authors a ON a.id = r.author_id
      UNION ALL SELECT id, 1, broker || ' desk', '' FROM reports WHERE NOT deleted""",
)
def author_projection(t):
    joined = t.reports.join(
        t.authors.select(F.col("id").alias("author_id"), "name", "cert"), "author_id"
    )
    analyses = joined.selectExpr(
        "id AS report_id",
        "id * 2 AS analysis_id",
        "array(named_struct('name', ' ', 'cert', 'x'), named_struct('name', ' ' || name, 'cert', cert), "
        "named_struct('name', CASE WHEN deleted THEN '' ELSE broker || ' desk' END, 'cert', ' ')) AS authors",
    )
    return extraction.author_projection(analyses).select("report_id", "seq", "name", text("cert"))


# every line is one small extraction with two items
_LINE = "l_orderkey * 10 + l_linenumber AS analysis_id, l_orderkey AS report_id"


@query(
    "x8_theme_projection",
    """SELECT l_orderkey * 10 + l_linenumber AS analysis_id, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS seq, 'T' || CAST(l_suppkey AS VARCHAR) AS raw_name, '' AS reason, count(*) AS n FROM lineitem GROUP BY ALL
       UNION ALL SELECT l_orderkey * 10 + l_linenumber, 0, 'T' || CAST(l_partkey AS VARCHAR), l_returnflag, count(*) FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL""",
)
def theme_projection(t):
    themes = (
        "array(named_struct('name', CASE WHEN l_returnflag = 'N' THEN ' ' ELSE ' T' || l_partkey END, 'reason', l_returnflag), "
        "named_struct('name', 'T' || l_suppkey, 'reason', CAST(NULL AS STRING))) AS themes"
    )
    analyses = t.raw("lineitem").selectExpr(*_LINE.split(", "), themes)
    # an order repeats line numbers, so equal rows are counted
    return (
        extraction.theme_projection(analyses)
        .groupBy("analysis_id", "seq", "raw_name", "reason")
        .agg(F.count("*").alias("n"))
    )


@query(
    "x9_target_projection",
    """SELECT l_orderkey * 10 + l_linenumber AS analysis_id, l_orderkey AS report_id, 0 AS seq, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, l_returnflag AS stance, count(*) AS n FROM lineitem GROUP BY ALL
       UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_orderkey, 1, lpad(CAST(l_partkey AS VARCHAR), 6, '0'), l_linestatus, count(*) FROM lineitem GROUP BY ALL""",
)
def target_projection(t):
    targets = (
        "array(named_struct('code', lpad(CAST(l_suppkey AS STRING), 6, '0'), 'stance', l_returnflag), "
        "named_struct('code', lpad(CAST(l_partkey AS STRING), 6, '0'), 'stance', l_linestatus)) AS targets"
    )
    analyses = t.raw("lineitem").selectExpr(*_LINE.split(", "), targets)
    return (
        extraction.target_projection(analyses)
        .groupBy("analysis_id", "report_id", "seq", "code", "stance")
        .agg(F.count("*").alias("n"))
    )


@query(
    "x10_reanalysis_plan",
    ctes("reports", "bodies")
    + """ SELECT q.report_id, min(q.position) AS position,
        CASE WHEN max(r.id) IS NULL THEN 'not_found' WHEN max(d.doc_id) IS NULL THEN 'markdown_missing' ELSE 'ready' END AS plan
      FROM (SELECT c_custkey * 7 AS report_id, c_custkey AS position FROM customer UNION ALL SELECT c_custkey, c_custkey + 1000000 FROM customer) q
      LEFT JOIN (SELECT id FROM reports WHERE NOT deleted) r ON r.id = q.report_id LEFT JOIN bodies d ON d.doc_id = q.report_id GROUP BY q.report_id""",
)
def reanalysis_plan(t):
    customers = t.raw("customer")
    requests = customers.selectExpr("c_custkey * 7 AS report_id", "c_custkey AS position").unionByName(
        customers.selectExpr("c_custkey AS report_id", "c_custkey + 1000000 AS position")
    )
    bodies = t.bodies.selectExpr("doc_id AS report_id", "doc_id AS file_id")
    return extraction.plan_reanalysis(requests, t.reports, bodies).drop("file_id")
