"""Full-text retrieval and the data side of synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import EVIDENCE_REPORTS
from ..functions.fields import search_tokens
from ..operators import extraction, retrieval, synthesis, views
from ..session import shared_folder
from .registry import query
from .standins import ctes
from .view_queries import HEADS, text

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _postings_sql(where="true", body="body"):
    """Postings of title, body and summary in the check SQL."""
    part = lambda field, column: f"SELECT doc_id AS report_id, '{field}' AS field, unnest({_WORDS.format(column)}) AS token FROM bodies WHERE {where}"
    return (
        f"(SELECT report_id, token, field, count(*) AS tf FROM ({part('A', 'title')} UNION ALL {part('B', body)} "
        f"UNION ALL {part('C', _SUMMARY)}) GROUP BY 1, 2, 3)"
    )


_SUMMARY = "broker || ' summary in ' || lang"


def postings(t, bodies=None):
    rows = t.spread(t.bodies if bodies is None else bodies)
    return retrieval.build_postings(
        rows.select(F.col("doc_id").alias("id"), "title"),
        rows.select(F.col("doc_id").alias("report_id"), "body"),
        rows.select(F.col("doc_id").alias("report_id"), F.expr(_SUMMARY).alias("summary")),
    )


@query("r1_index_build", ctes("bodies") + f" SELECT * FROM {_postings_sql()}")
def index_build(t):
    return postings(t)


def _stored_index(t):
    """All bodies as an index of two segments: the German ones were converted later."""
    index = shared_folder(t.spark, "text-index")
    later = F.coalesce(F.col("lang") == "de", F.lit(False))
    retrieval.add_segment(index, 0, postings(t, t.bodies.where(~later)))
    retrieval.add_segment(index, 1, postings(t, t.bodies.where(later)))
    return retrieval.read_index(t.spark, index)


@query(
    "r2_conjunctive_match",
    ctes("bodies")
    + f""", p AS {_postings_sql()} SELECT report_id, CAST(sum(tf) AS BIGINT) AS hits FROM p WHERE token IN ('the', 'summary', 'en') GROUP BY report_id HAVING count(DISTINCT token) = 3""",
)
def conjunctive_match(t):
    return retrieval.search(_stored_index(t), " The summary, EN ")


@query(
    "r2_report_search",
    ctes("bodies", "reports")
    + f""", p AS {_postings_sql()}, found AS (SELECT report_id FROM p WHERE token IN ('the', 'summary') GROUP BY report_id HAVING count(DISTINCT token) = 2)
     SELECT id, title, broker, CAST(publish_date AS VARCHAR) AS publish_date FROM reports WHERE NOT deleted AND publish_date >= DATE '1993-01-01' AND id IN (SELECT report_id FROM found)""",
)
def report_search(t):
    """The report list under a date filter and a text query."""
    matching = retrieval.matching_reports(_stored_index(t), "summary the")
    rows = views.report_list(t.reports, date_from="1993-01-01", matching=matching)
    return rows.select("id", "title", "broker", text("publish_date"))


@query(
    "r3_tokens",
    ctes("bodies") + f" SELECT doc_id, len({_WORDS.format('body')}) AS n_tokens, md5(array_to_string({_WORDS.format('body')}, ' ')) AS tokens_md5 FROM bodies",
)
def tokens(t):
    return t.spread(t.bodies).select("doc_id", search_tokens(F.col("body")).alias("tokens")).select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5")
    )


@query(
    "r4_index_rebuild",
    ctes("bodies") + f" SELECT token, field, count(*) AS reports, CAST(sum(tf) AS BIGINT) AS occurrences FROM {_postings_sql()} GROUP BY 1, 2",
)
def index_rebuild(t):
    _, index = retrieval.rebuild(t.spark, postings(t))
    return index.groupBy("token", "field").agg(F.count("*").alias("reports"), F.sum("tf").alias("occurrences"))


@query(
    "r5_index_refresh",
    ctes("bodies")
    + f""", p AS (SELECT * FROM {_postings_sql("doc_id NOT IN (SELECT doc_id FROM labels)")} UNION ALL SELECT * FROM {_postings_sql("doc_id IN (SELECT doc_id FROM labels)", "'Revised ' || body")})
    SELECT report_id, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY report_id""",
)
def index_refresh(t):
    """The labelled documents are touched: their bodies were revised."""
    touched = t.raw("labels").select(F.col("doc_id").alias("report_id"))
    revised = t.bodies.join(t.raw("labels").select("doc_id"), "doc_id", "left_semi").withColumn(
        "body", F.concat(F.lit("Revised "), "body")
    )
    index = shared_folder(t.spark, "text-index")
    retrieval.add_segment(index, 0, postings(t))
    retrieval.add_segment(index, 1, postings(t, revised), touched)
    refreshed = retrieval.read_index(t.spark, index)
    return refreshed.groupBy("report_id").agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))


_LIMIT = EVIDENCE_REPORTS
_EVIDENCE = f"""{HEADS}, pairs AS (SELECT DISTINCT theme_id, report_id, publish_date FROM current_links),
 evidence AS (SELECT theme_id, position, report_id, total, total > {_LIMIT} AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY publish_date DESC, report_id DESC) AS position,
   count(*) OVER (PARTITION BY theme_id) AS total FROM pairs) WHERE position <= {_LIMIT})"""


def _evidence(t):
    return synthesis.select_evidence(t.links, t.reports, _LIMIT)


@query("y1_evidence_selection", ctes("reports", "links") + f", {_EVIDENCE} SELECT theme_id, position, report_id, total, truncated FROM evidence")
def evidence_selection(t):
    return _evidence(t).withColumn("position", F.col("position").cast("long"))


_PRINTS = "prints AS (SELECT theme_id, sha256('[' || string_agg(CAST(report_id AS VARCHAR), ',' ORDER BY report_id) || ']') AS input_fingerprint, count(*) AS n_reports FROM evidence GROUP BY theme_id)"


@query("y2_input_fingerprint", ctes("reports", "links") + f", {_EVIDENCE}, {_PRINTS} SELECT * FROM prints")
def input_fingerprint(t):
    return synthesis.fingerprint(_evidence(t))


@query(
    "y3_cache_decision",
    ctes("reports", "links", "themes", "versions")
    + f""", {_EVIDENCE}, {_PRINTS}, stored AS (SELECT v.report_id AS theme_id, version, CASE WHEN model = 'user' THEN 'old' ELSE input_fingerprint END AS fp FROM versions v JOIN prints p ON p.theme_id = v.report_id),
    last AS (SELECT theme_id, max(version) AS version, arg_max(fp, version) AS fp FROM stored GROUP BY theme_id)
    SELECT r.c_custkey AS theme_id, CASE WHEN t.id IS NULL THEN 'missing' WHEN t.status IN ('merged', 'retired') THEN 'unavailable' WHEN p.theme_id IS NULL THEN 'empty'
      WHEN r.c_acctbal < 8000 AND l.fp = p.input_fingerprint THEN 'cached' ELSE 'recompute' END AS decision,
      CASE WHEN t.status IN ('active', 'pending') AND r.c_acctbal < 8000 AND l.fp = p.input_fingerprint THEN l.version ELSE -1 END AS cached_version
    FROM customer r LEFT JOIN themes t ON t.id = r.c_custkey LEFT JOIN prints p ON p.theme_id = r.c_custkey LEFT JOIN last l ON l.theme_id = r.c_custkey""",
)
def cache_decision(t):
    prints = synthesis.fingerprint(_evidence(t))
    stored = t.versions.withColumnRenamed("report_id", "theme_id").join(prints, "theme_id").select(
        "theme_id", "version", F.expr("CASE WHEN model = 'user' THEN 'old' ELSE input_fingerprint END").alias("input_fingerprint")
    )
    requests = t.raw("customer").selectExpr("c_custkey AS theme_id", "c_acctbal >= 8000 AS force")
    decided = synthesis.cache_decision(requests, t.themes, prints, stored)
    return decided.select("theme_id", "decision", F.coalesce("cached_version", F.lit(-1)).alias("cached_version"))


@query(
    "y4_revalidation",
    """WITH s AS (SELECT p_partkey AS theme_id, unnest([p_partkey, p_partkey * 3, p_partkey + 7, p_partkey * 50]) AS report_id, unnest(range(4)) AS pos FROM part)
    SELECT theme_id, row_number() OVER (PARTITION BY theme_id ORDER BY pos) AS position, report_id FROM s JOIN orders ON o_orderkey = report_id
    WHERE o_orderstatus <> 'P' AND o_orderpriority <> '4-NOT SPECIFIED'""",
)
def revalidation(t):
    snapshots = t.raw("part").selectExpr("p_partkey AS theme_id", "array(p_partkey, p_partkey * 3, p_partkey + 7, p_partkey * 50) AS report_ids")
    return synthesis.revalidate(snapshots, t.reports).withColumn("position", F.col("position").cast("long"))


_SEQ = "line_no, theme_id, code_no, amount"


@query(
    "y5_digest",
    ctes("reports", "links")
    + f""", {_EVIDENCE}, items AS (SELECT c.report_id, string_agg('T' || CAST(theme_id AS VARCHAR) || '(' || CASE WHEN stance = '回避' THEN '' ELSE target_code || ',' END || stance || ')', '；' ORDER BY {_SEQ}) AS targets FROM current_links c GROUP BY 1),
    blocks AS (SELECT e.theme_id, e.position, '[R' || CAST(position AS VARCHAR) || '] 券商=' || r.broker || ' 日期=' || CAST(r.publish_date AS VARCHAR) || ' 标题=' || r.title
       || CASE WHEN r.author_id % 3 = 0 THEN '' ELSE chr(10) || '总结：s' || CAST(r.id AS VARCHAR) END || chr(10) || '标的：' || targets || chr(10) || '评级：' || r.action_word AS b
      FROM evidence e JOIN reports r ON r.id = e.report_id JOIN items i ON i.report_id = e.report_id),
    codes AS (SELECT e.theme_id, count(DISTINCT c.target_code) AS n FROM evidence e JOIN current_links c ON c.report_id = e.report_id WHERE stance <> '回避' GROUP BY 1)
    SELECT b.theme_id, count(*) AS n_reports, md5(string_agg(b, chr(10) || chr(10) ORDER BY position)) AS digest_md5, coalesce(max(n), 0) AS n_codes FROM blocks b LEFT JOIN codes c ON c.theme_id = b.theme_id GROUP BY b.theme_id""",
)
def digest(t):
    evidence = _evidence(t)
    analyses = t.reports.select(
        F.col("current_analysis_id").alias("analysis_id"), F.expr("CASE WHEN author_id % 3 = 0 THEN ' ' ELSE 's' || id END").alias("summary"), F.col("action_word").alias("action")
    )
    links = t.links.select(
        "analysis_id", F.struct("line_no", "theme_id", "code_no", "amount").alias("seq"), F.expr("'T' || theme_id").alias("raw_name"),
        F.expr("CASE WHEN stance = '回避' THEN NULL ELSE target_code END").alias("target_code"), "stance",
    )
    digests = synthesis.build_digests(evidence, synthesis.report_blocks(t.reports, analyses, links))
    codes = synthesis.known_codes(evidence, t.reports, links).groupBy("theme_id").agg(F.count("*").alias("n_codes"))
    return digests.join(codes, "theme_id", "left").select(
        "theme_id", F.col("n_reports").cast("long").alias("n_reports"), F.md5(F.col("digest").cast("binary")).alias("digest_md5"), F.coalesce("n_codes", F.lit(0)).alias("n_codes")
    )


_CITED = r"""'{"common_conclusions":[{"text":" c' || k || ' ","report_refs":[2.7,"3",true,"2.7",99,' || k || ',-1,null]},{"text":"none","report_refs":[0,"x"]},{"text":"","report_refs":[1]},7],' ||
 '"consensus_targets":[{"name":"n","code":"SZ' || lpad(CAST(k AS STRING), 6, '0') || '","view":"v","report_refs":[5,4,5]},{"name":"m","code":"12","report_refs":["4"]}],"divergences":"no"}'"""


@query(
    "y6_citations",
    ctes("log")
    + """, base AS (SELECT event_id, k FROM log), refs AS (SELECT event_id, k, unnest([1, 2, 3, k]) AS r FROM base)
    SELECT event_id AS theme_id, 'common_conclusions' AS part, 'c' || CAST(k AS VARCHAR) AS text, '' AS code, string_agg(DISTINCT CAST(r AS VARCHAR), ',' ORDER BY CAST(r AS VARCHAR)) AS refs FROM refs WHERE r BETWEEN 1 AND 9 GROUP BY event_id, k
    UNION ALL SELECT event_id, 'consensus_targets', 'n', CASE WHEN k <= 50 THEN lpad(CAST(k AS VARCHAR), 6, '0') ELSE '' END, '4,5' FROM base
    UNION ALL SELECT event_id, 'consensus_targets', 'm', '', '4' FROM base""",
)
def citations(t):
    answers = t.spread(t.log).select("event_id", "k", F.expr(_CITED).alias("raw"))
    parsed = extraction.repair_json(answers).select(
        F.col("event_id").alias("theme_id"), "payload", F.lit(9).alias("n_reports")
    )
    codes = t.log.where("k <= 50").select(
        F.col("event_id").alias("theme_id"), F.expr("lpad(CAST(k AS STRING), 6, '0')").alias("code")
    )
    items = synthesis.keep_known_codes(synthesis.cited_items(parsed), codes)
    return items.select("theme_id", "part", "text", text("code"), F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


@query(
    "y7_synthesis_versions",
    ctes("log")
    + """, old AS (SELECT subscription_id AS theme_id, count(*) AS last FROM log WHERE event = 'purchase' GROUP BY 1)
    SELECT l.subscription_id AS theme_id, event_id AS arrival, coalesce(last, 0) + row_number() OVER (PARTITION BY l.subscription_id ORDER BY event_id) AS version,
      event_id = max(event_id) OVER (PARTITION BY l.subscription_id) AS is_head, amount AS duration
    FROM log l LEFT JOIN old o ON o.theme_id = l.subscription_id WHERE event <> 'purchase'""",
)
def synthesis_versions(t):
    """Purchases are the stored versions of a theme, the other events arrive with audit columns."""
    heads = t.log.where("event = 'purchase'").groupBy(F.col("subscription_id").alias("theme_id")).agg(F.count("*").alias("version"))
    batch = t.log.where("event <> 'purchase'").select(
        F.col("subscription_id").alias("theme_id"), F.col("event_id").alias("arrival"), F.col("amount").alias("duration")
    )
    return extraction.append_versions(heads, batch, "theme_id", "arrival")


@query(
    "y8_synthesis_detail",
    ctes("reports")
    + """, s AS (SELECT p_partkey AS synthesis_id, unnest([p_partkey * 9, p_partkey, p_partkey * 100]) AS report_id, unnest(range(3)) AS pos FROM part)
    SELECT synthesis_id, pos + 1 AS position, report_id, coalesce(title, '#' || CAST(report_id AS VARCHAR) || '（已删除）') AS title, coalesce(broker, '') AS broker,
      CAST(coalesce(publish_date, DATE '1970-01-01') AS VARCHAR) AS publish_date FROM s LEFT JOIN reports ON id = report_id""",
)
def synthesis_detail(t):
    syntheses = t.raw("part").selectExpr("p_partkey AS synthesis_id", "array(p_partkey * 9, p_partkey, p_partkey * 100) AS report_ids")
    rows = synthesis.detail_view(syntheses, t.reports)
    return rows.withColumn("position", F.col("position").cast("long")).withColumn("publish_date", F.col("publish_date").cast("string"))
