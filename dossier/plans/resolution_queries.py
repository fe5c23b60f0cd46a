"""Security master and company resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import normalize_name
from ..operators import master, resolve
from ..session import cut_lineage
from .landing_queries import INDUSTRY, industry_names
from .registry import query
from .standins import ctes

text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

# lineitem as the industry history of the securities; some industry codes are not in the code table
_HISTORY = {
    "code": "lpad(CAST({key} AS VARCHAR(20)), 6, '0')",
    "effective_date": "CAST(l_shipdate AS DATE)",
    "source_updated_at": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) END",
    "nation": "l_partkey % 30",
}


def _history_sql(key):
    cols = ", ".join(f"{e.format(key=key)} AS {c}" for c, e in _HISTORY.items())
    return f"""names AS ({INDUSTRY}), raw_hist AS (SELECT {cols} FROM lineitem),
      hist AS (SELECT code, effective_date, source_updated_at, coalesce(l3_code, '99' || lpad(CAST(nation AS VARCHAR), 4, '0')) AS industry_code
        FROM raw_hist LEFT JOIN names ON l2_name = 'NATION_' || CAST(nation AS VARCHAR))"""


def _history(t, key):
    cols = [f"{e.format(key=key)} AS {c}" for c, e in _HISTORY.items()]
    names = industry_names(t).select(F.col("l2_name"), F.col("l3_code"))
    rows = t.raw("lineitem").selectExpr(*cols).withColumn("l2_name", F.expr("'NATION_' || nation"))
    return rows.join(names, "l2_name", "left").select(
        "code",
        "effective_date",
        "source_updated_at",
        F.coalesce("l3_code", F.expr("'99' || lpad(CAST(nation AS STRING), 4, '0')")).alias("industry_code"),
    )


_LATEST_SQL = """latest AS (SELECT code, industry_code, effective_date FROM (SELECT *, row_number() OVER (PARTITION BY code
   ORDER BY effective_date DESC, source_updated_at DESC NULLS LAST, industry_code DESC) AS rn FROM hist) WHERE rn = 1),
 classified AS (SELECT code, coalesce(l1_code, left(industry_code, 2)) AS l1_code, coalesce(l2_code, left(industry_code, 4)) AS l2_code,
   coalesce(l2_name, '') AS l2_name, industry_code AS l3_code, CAST(effective_date AS VARCHAR) AS effective_date FROM latest LEFT JOIN names ON l3_code = industry_code)"""


@query(
    "e1_master_upsert",
    f"""WITH {_history_sql('l_partkey')}, {_LATEST_SQL},
    old AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS name FROM supplier),
    stock AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_name AS name FROM customer WHERE c_mktsegment <> 'FURNITURE')
    SELECT code, coalesce(s.name, o.name, '') AS name, upper(coalesce(s.name, o.name, '')) AS name_norm,
      CASE WHEN s.name IS NULL AND o.name IS NULL THEN '' ELSE 'SZ' END AS exchange, coalesce(l3_code, '') AS l3_code, coalesce(c.l2_name, '') AS l2_name
    FROM old o FULL JOIN stock s USING (code) FULL JOIN classified c USING (code)""",
)
def master_upsert(t):
    """Suppliers are the stored master, customers the new list, parts appear in the history."""
    existing = t.raw("supplier").selectExpr(
        "lpad(CAST(s_suppkey AS STRING), 6, '0') AS code",
        "s_name AS name",
        "upper(s_name) AS name_norm",
        "'SZ' AS exchange",
        *[f"CAST(NULL AS STRING) AS {c}" for c in master.INDUSTRY_FIELDS[:-1]],
        "CAST(NULL AS DATE) AS effective_date",
        "array() AS historical_names",
    )
    stocks = t.raw("customer").selectExpr(
        "CASE WHEN c_mktsegment = 'FURNITURE' THEN 'n/a' ELSE lpad(CAST(c_custkey AS STRING), 6, '0') END AS code",
        "c_name AS name",
    )
    industry = master.latest_industry(_history(t, "l_partkey"), industry_names(t))
    return master.upsert_master(existing, stocks, industry).select(
        "code", "name", "name_norm", "exchange", text("l3_code"), text("l2_name")
    )


@query(
    "e2_latest_industry",
    f"WITH {_history_sql('l_suppkey')}, {_LATEST_SQL} SELECT * FROM classified",
)
def latest_industry(t):
    return master.latest_industry(_history(t, "l_suppkey"), industry_names(t)).select(
        "code", "l1_code", "l2_code", text("l2_name"), "l3_code", text("effective_date")
    )


@query(
    "e3_history_append",
    f"""WITH {_history_sql('l_suppkey')} SELECT code, CAST(effective_date AS VARCHAR) AS effective_date, industry_code,
      coalesce(CAST(CAST(min(source_updated_at) AS DATE) AS VARCHAR), '') AS updated FROM hist h
      WHERE NOT EXISTS (SELECT 1 FROM hist o WHERE o.effective_date < DATE '1998-01-01' AND o.code = h.code AND o.effective_date = h.effective_date AND o.industry_code = h.industry_code)
      GROUP BY code, h.effective_date, industry_code""",
)
def history_append(t):
    rows = _history(t, "l_suppkey")
    stored = rows.where("effective_date < DATE '1998-01-01'").select(*master.HISTORY_KEY).distinct()
    new = master.append_history(stored, rows)
    return new.select(
        "code",
        text("effective_date"),
        "industry_code",
        F.coalesce(F.to_date("source_updated_at").cast("string"), F.lit("")).alias("updated"),
    )


@query(
    "e4_historical_names",
    """SELECT p_partkey, p_name || '|' || p_brand || CASE WHEN p_type IN (p_name, p_brand) THEN '' ELSE '|' || p_type END AS names FROM part""",
)
def historical_names(t):
    names = master.union_historical_names(
        F.array("p_name", "p_brand"),
        F.array(F.lit(""), F.col("p_brand"), F.col("p_type"), F.expr("'now ' || p_name"), F.col("p_type")),
        F.expr("'now ' || p_name"),
    )
    return t.raw("part").select("p_partkey", F.array_join(names, "|").alias("names"))


# part as a master with many equal names
_PART_KEY = r"regexp_replace(upper(replace({}, ' ', '')), '^(S?\*?ST)+', '')"
_DICT_SQL = f"""dict AS (SELECT DISTINCT key, code FROM (
   SELECT {_PART_KEY.format("p_name || p_brand")} AS key, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code FROM part
   UNION ALL SELECT {_PART_KEY.format("p_name || p_type")}, lpad(CAST(p_partkey AS VARCHAR), 6, '0') FROM part))"""


def _dictionary(t):
    parts = t.spread(t.raw("part")).select(
        F.expr("lpad(CAST(p_partkey AS STRING), 6, '0')").alias("code"),
        normalize_name(F.expr("p_name || ' ' || p_brand")).alias("name_norm"),
        F.array(F.expr("p_name || p_type || '集团'")).alias("historical_names"),
    )
    return master.name_dictionary(parts)


@query("e5_name_dictionary", f"WITH {_DICT_SQL} SELECT key, code FROM dict")
def name_dictionary(t):
    return _dictionary(t)


def _mentioned(t):
    """Names as reports write them: known ones with marks and suffixes, and unknown ones."""
    parts = t.spread(t.raw("part"))
    return (
        parts.select(F.expr("'*ST' || p_name || ' ' || p_brand || '公司'").alias("name"))
        .unionByName(parts.select(F.expr("p_name || p_size").alias("name")))
        .select(normalize_name(F.col("name")).alias("key"))
        .distinct()
    )


_NAMES_SQL = f"""mentioned AS (SELECT DISTINCT {_PART_KEY.format("p_name || p_brand")} AS key FROM part
  UNION SELECT DISTINCT {_PART_KEY.format("p_name || CAST(p_size AS VARCHAR)")} FROM part)"""


@query(
    "e6_exact_names",
    f"""WITH {_DICT_SQL}, {_NAMES_SQL}, v AS (SELECT key, count(*) AS n, min(code) AS code FROM mentioned JOIN dict USING (key) GROUP BY key)
    SELECT key, CASE WHEN n = 1 THEN code ELSE '' END AS code, CASE WHEN n > 1 THEN 'multi_candidate' ELSE '' END AS reason, n AS n_codes, '' AS candidate FROM v
    UNION ALL SELECT key, '', 'candidate', 0, d.code FROM v JOIN dict d USING (key) WHERE n > 1""",
)
def exact_names(t):
    dictionary = cut_lineage(_dictionary(t), "name-dictionary")
    verdicts, candidates = resolve.exact_stage(_mentioned(t), dictionary)
    sizes = dictionary.groupBy("key").agg(F.count("*").alias("n_codes"))
    shown = verdicts.join(sizes, "key").select("key", text("code"), text("reason"), "n_codes", F.lit("").alias("candidate"))
    return shown.unionByName(
        candidates.select("key", F.lit("").alias("code"), F.lit("candidate").alias("reason"), F.lit(0).cast("long").alias("n_codes"), F.col("code").alias("candidate"))
    )


def _letters(c):
    """How often each letter and digit occurs in a key."""
    return f"list_transform(range(1, 37), lambda i: length({c}) - length(replace({c}, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', i, 1), '')))"


# the longest common block of a and b, the first in a (place negated), as (k, i); the first in b is found from it
_BLOCK = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(
  list_filter(range(1, length(a) - i + 2), lambda k: contains(b, substr(a, i, k))), lambda k: struct_pack(k := k, i := -i)))))"""


def _ratio_sql(name, pairs):
    """(key, entry, score): blocks are matched longest first, then left and right of the block."""
    return f"""{name}_seg AS (SELECT key, entry, key AS a, entry AS b, {_BLOCK} AS m FROM (SELECT *, key AS a, entry AS b FROM {pairs}) UNION ALL
  SELECT key, entry, a, b, {_BLOCK} FROM (SELECT key, entry, p.a AS a, p.b AS b FROM (SELECT key, entry, unnest([
      struct_pack(a := left(a, -m.i - 1), b := left(b, strpos(b, substr(a, -m.i, m.k)) - 1)),
      struct_pack(a := substr(a, -m.i + m.k), b := substr(b, strpos(b, substr(a, -m.i, m.k)) + m.k))]) AS p FROM {name}_seg WHERE m IS NOT NULL)
    WHERE p.a <> '' AND p.b <> '')),
 {name} AS (SELECT key, entry, 2.0 * sum(coalesce(m.k, 0)) / (length(key) + length(entry)) AS score FROM {name}_seg GROUP BY key, entry)"""


@query(
    "e7_fuzzy_names",
    f"""WITH RECURSIVE {_DICT_SQL}, asked AS (SELECT DISTINCT {_PART_KEY.format("p_name || 's ' || p_brand")} AS key FROM part
   UNION SELECT DISTINCT {_PART_KEY.format("c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR)")} FROM customer),
 exact AS (SELECT key, count(*) AS n, min(code) AS code FROM asked JOIN dict USING (key) GROUP BY key),
 names AS (SELECT key, {_letters("key")} AS v FROM asked WHERE key <> '' AND key NOT IN (SELECT key FROM exact)),
 entries AS (SELECT key AS entry, {_letters("key")} AS w FROM (SELECT DISTINCT key FROM dict)),
 bounds AS (SELECT key, entry, 2.0 * (length(key) + length(entry) - (list_sum(list_transform(range(1, 37), lambda i: abs(v[i] - w[i]))))) / 2 / (length(key) + length(entry)) AS most
   FROM names, entries),
 likely AS (SELECT key, entry FROM bounds WHERE most >= 0.85), {_ratio_sql("high", "likely")},
 hits AS (SELECT h.key, d.code, max(score) AS score FROM high h JOIN dict d ON d.key = h.entry WHERE score >= 0.85 GROUP BY h.key, d.code),
 missed AS (SELECT key FROM names WHERE key NOT IN (SELECT key FROM hits)),
 possible AS (SELECT key, entry FROM bounds WHERE most > 0.5 AND key IN (SELECT key FROM missed)), {_ratio_sql("low", "possible")},
 near AS (SELECT key, code, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, code) AS r
   FROM (SELECT l.key, d.code, max(score) AS score FROM low l JOIN dict d ON d.key = l.entry WHERE score > 0.5 GROUP BY l.key, d.code)) WHERE r <= 3),
 per AS (SELECT key, count(*) AS n, min(code) AS code FROM hits GROUP BY key)
 SELECT key, CASE WHEN n = 1 THEN code ELSE '' END AS code, CASE WHEN n = 1 THEN '' ELSE 'multi_candidate' END AS reason, 1.0::DOUBLE AS score FROM (FROM exact UNION ALL FROM per)
 UNION ALL SELECT key, '', 'no_hit', 1.0 FROM missed
 UNION ALL SELECT key, d.code, 'candidate', 1.0 FROM exact e JOIN dict d USING (key) WHERE n > 1
 UNION ALL SELECT key, h.code, 'candidate', round(score, 3) FROM hits h JOIN per USING (key) WHERE n > 1
 UNION ALL SELECT key, code, 'candidate', round(score, 3) FROM near""",
)
def fuzzy_names(t):
    """Customer and part names without an exact entry against the part dictionary."""
    names = (
        t.spread(t.raw("part")).select(F.expr("p_name || 's ' || p_brand").alias("name"))
        .unionByName(t.spread(t.raw("customer")).select(F.expr("c_mktsegment || ' ' || c_nationkey").alias("name")))
        .select(normalize_name(F.col("name")).alias("key"))
        .distinct()
    )
    # both feed the exact and the fuzzy stage
    names, dictionary = cut_lineage(names, "names"), cut_lineage(_dictionary(t), "name-dictionary")
    verdicts, candidates = resolve.resolve_names(names, dictionary, K.NEAR_HINTS)
    return verdicts.select("key", text("code"), text("reason"), F.lit(1.0).alias("score")).unionByName(
        candidates.select("key", "code", F.lit("candidate").alias("reason"), "score")
    )


_MENTION = {
    "report_id": "l_orderkey",
    "line": "l_linenumber",
    "raw_code": "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE lpad(CAST(l_partkey * 2 AS VARCHAR(20)), 6, '0') END",
    "raw_source": "CASE WHEN l_returnflag = 'A' THEN 'text' WHEN l_returnflag = 'R' THEN 'inferred' ELSE NULL END",
    "name_no": "l_partkey",
}
_MENTION_SQL = f"""mentions AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _MENTION.items())}, {_PART_KEY.format("p_name || p_brand")} AS key
   FROM lineitem JOIN part ON p_partkey = l_partkey),
 v AS (SELECT key, count(*) AS n, min(code) AS code FROM dict GROUP BY key),
 routed AS (SELECT m.*, CASE WHEN raw_code IS NOT NULL AND raw_source = 'text' AND p.p_partkey IS NOT NULL THEN ''
    WHEN raw_code IS NOT NULL AND (raw_source IS NULL OR raw_source <> 'text') THEN 'inferred_code' WHEN raw_code IS NOT NULL THEN 'code_not_in_master'
    WHEN v.n = 1 THEN '' ELSE 'multi_candidate' END AS reason, v.n, v.code AS by_name, p.p_partkey IS NOT NULL AS in_master
   FROM mentions m LEFT JOIN v USING (key) LEFT JOIN part p ON lpad(CAST(p.p_partkey AS VARCHAR), 6, '0') = raw_code)"""


def _routed(t):
    names = t.spread(t.raw("part")).select(
        F.col("p_partkey").alias("name_no"), normalize_name(F.expr("p_name || p_brand")).alias("key")
    )
    mentions = t.raw("lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _MENTION.items()]).join(names, "name_no")
    # the dictionary is a stored table: it feeds verdicts, candidates and hints
    dictionary = cut_lineage(_dictionary(t), "name-dictionary")
    verdicts, candidates = resolve.exact_stage(names.select("key").distinct(), dictionary)
    codes = t.raw("part").select(F.expr("lpad(CAST(p_partkey AS STRING), 6, '0')").alias("code"))
    return resolve.route_mentions(mentions, verdicts, codes), verdicts, candidates


@query(
    "e8_code_routing",
    f"""WITH {_DICT_SQL}, {_MENTION_SQL} SELECT report_id, line, name_no, coalesce(raw_code, '') AS raw_code, reason,
    CASE WHEN reason <> '' THEN '' WHEN raw_code IS NOT NULL THEN raw_code ELSE by_name END AS target_code FROM routed""",
)
def code_routing(t):
    routed, _, _ = _routed(t)
    return routed.select("report_id", "line", "name_no", text("raw_code"), text("reason"), text("target_code"))


@query(
    "e8_inferred_candidates",
    f"""WITH {_DICT_SQL}, {_MENTION_SQL}, asked AS (SELECT DISTINCT key, raw_code, in_master, n, by_name FROM routed WHERE reason = 'inferred_code'),
    own AS (SELECT key, raw_code, raw_code AS code, 0 AS r FROM asked a WHERE in_master AND NOT EXISTS (SELECT 1 FROM dict d WHERE d.key = a.key AND d.code = a.raw_code)),
    listed AS (SELECT a.key, a.raw_code, d.code, 1 AS r FROM asked a JOIN dict d ON d.key = a.key),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key, raw_code ORDER BY r, code) AS rank FROM (SELECT * FROM own UNION ALL SELECT * FROM listed))
    SELECT key, raw_code, code, rank FROM ranked WHERE rank <= 5""",
)
def inferred_candidates(t):
    routed, verdicts, candidates = _routed(t)
    hints = resolve.inferred_candidates(routed, verdicts, candidates, K.INFERRED_HINTS)
    return hints.select("key", "raw_code", "code", F.col("rank").cast("long").alias("rank"))


_LINK = {
    "report_id": "l_orderkey",
    "line_no": "l_linenumber",
    "key": "'P' || CAST(l_partkey % 3 AS VARCHAR(9))",
    "raw_code": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE lpad(CAST(l_suppkey % 2 AS VARCHAR(9)), 6, '0') END",
    "reason": "CASE WHEN l_quantity > 40 THEN NULL ELSE 'no_hit' END",
    "target_code": "CASE WHEN l_quantity > 40 THEN '600000' ELSE NULL END",
    "code_source": "CASE WHEN l_quantity > 40 THEN 'text' ELSE NULL END",
}
# every label is a decision on its document's report
_DECISION = {
    "match_id": "doc_id",
    "report_id": "doc_id",
    "key": "'P' || CAST(doc_id % 3 AS VARCHAR(9))",
    "raw_code": "CASE WHEN quality = 0 THEN NULL ELSE lpad(CAST(doc_id % 2 AS VARCHAR(9)), 6, '0') END",
    "status": "CASE WHEN toxic = 1 THEN 'dismissed' WHEN quality = 1 THEN 'confirmed' ELSE 'pending' END",
    "resolved_code": "CASE WHEN quality = 1 THEN '300001' ELSE NULL END",
}


def _select(df, columns):
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _sql(columns):
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


@query(
    "e9_decision_reuse",
    f"""WITH link AS (SELECT {_sql(_LINK)} FROM lineitem), dec AS (SELECT {_sql(_DECISION)} FROM labels)
    SELECT l.report_id, l.line_no, l.key, coalesce(l.raw_code, '') AS raw_code,
      coalesce(CASE WHEN l.reason IS NULL THEN l.target_code WHEN d.status = 'confirmed' THEN d.resolved_code END, '') AS target_code,
      coalesce(CASE WHEN l.reason IS NOT NULL AND d.status = 'confirmed' THEN 'manually_confirmed' ELSE l.code_source END, '') AS code_source,
      CASE WHEN l.reason IS NULL OR d.status = 'confirmed' THEN '' WHEN d.status = 'dismissed' THEN 'dismissed' ELSE 'pending' END AS match_status
    FROM link l LEFT JOIN dec d ON d.status <> 'pending' AND d.report_id = l.report_id AND d.key = l.key AND d.raw_code IS NOT DISTINCT FROM l.raw_code""",
)
def decision_reuse(t):
    reused = resolve.reuse_decisions(_select(t.raw("lineitem"), _LINK), _select(t.raw("labels"), _DECISION))
    return reused.select("report_id", "line_no", "key", text("raw_code"), text("target_code"), text("code_source"), text("match_status"))


@query(
    "e10_supersede_pending",
    f"""WITH dec AS (SELECT {_sql(_DECISION)} FROM labels) SELECT match_id, CASE WHEN status = 'pending' AND report_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
     THEN 'superseded' ELSE status END AS status FROM dec""",
)
def supersede_pending(t):
    reanalysed = t.raw("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("report_id"))
    return resolve.supersede_pending(_select(t.raw("labels"), _DECISION), reanalysed).select("match_id", "status")


_REQUEST = {
    "arrival": "p_partkey",
    "match_id": "p_partkey % 500",
    "action": "CASE WHEN p_type = 'PROMO' THEN 'dismiss' ELSE 'confirm' END",
    "code": "CASE WHEN p_type = 'PROMO' THEN NULL ELSE lpad(CAST(p_size * 4 AS VARCHAR(9)), 6, '0') END",
}


@query(
    "e11_review_decisions",
    f"""WITH req AS (SELECT {_sql(_REQUEST)} FROM part), dec AS (SELECT {_sql(_DECISION)} FROM labels),
    checked AS (SELECT r.*, d.status AS st, d.status = 'pending' AND (action = 'dismiss' OR EXISTS (SELECT 1 FROM supplier WHERE lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = r.code)) AS ok
      FROM req r LEFT JOIN dec d ON d.match_id = r.match_id),
    judged AS (SELECT *, min(CASE WHEN ok THEN arrival END) OVER (PARTITION BY match_id) AS f FROM checked)
    SELECT arrival, match_id, CASE WHEN st IS NULL THEN 'not_found' WHEN st <> 'pending' OR arrival > f THEN 'already_resolved' WHEN arrival = f THEN 'applied' ELSE 'unknown_code' END AS verdict,
      CASE WHEN arrival = f THEN CASE action WHEN 'confirm' THEN 'confirmed' ELSE 'dismissed' END ELSE '' END AS new_status FROM judged""",
)
def review_decisions(t):
    codes = t.targets.select("code")
    judged, changes = resolve.apply_decisions(
        _select(t.raw("part"), _REQUEST), _select(t.raw("labels"), _DECISION), codes
    )
    changed = changes.select("arrival", F.col("status").alias("new_status"))
    return judged.join(changed, "arrival", "left").select("arrival", "match_id", "verdict", text("new_status"))


@query(
    "e11_link_updates",
    f"""WITH req AS (SELECT {_sql(_REQUEST)} FROM part), dec AS (SELECT {_sql(_DECISION)} FROM labels),
    valid AS (SELECT r.*, row_number() OVER (PARTITION BY r.match_id ORDER BY arrival) AS nth FROM req r JOIN dec d ON d.match_id = r.match_id
      WHERE d.status = 'pending' AND (action = 'dismiss' OR EXISTS (SELECT 1 FROM supplier WHERE lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = r.code)))
    SELECT d.match_id, d.report_id, coalesce(CASE WHEN v.match_id IS NULL THEN d.raw_code WHEN v.action = 'confirm' THEN v.code END, '') AS target_code,
      CASE WHEN v.action = 'confirm' THEN 'manually_confirmed' ELSE 'fuzzy' END AS code_source
    FROM dec d LEFT JOIN valid v ON v.match_id = d.match_id AND v.nth = 1""",
)
def link_updates(t):
    """Target links after the review decisions: one link per review row, with the code read from the report."""
    rows = _select(t.raw("labels"), _DECISION)
    _, changes = resolve.apply_decisions(_select(t.raw("part"), _REQUEST), rows, t.targets.select("code"))
    links = rows.select("match_id", "report_id", F.col("raw_code").alias("target_code"), F.lit("fuzzy").alias("code_source"))
    updated = resolve.apply_to_links(links, changes)
    return updated.select("match_id", "report_id", text("target_code"), "code_source")


@query(
    "e12_bridge_vote",
    f"""WITH names AS ({INDUSTRY}), clf AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, l3_code AS industry_code FROM supplier JOIN names ON l2_name = 'NATION_' || CAST(s_nationkey AS VARCHAR) WHERE s_acctbal > 0),
    cons AS (SELECT DISTINCT l_partkey * 50 + l_linenumber AS index_code, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code FROM lineitem),
    votes AS (SELECT index_code, left(industry_code, 2) AS prefix, count(*) AS n FROM cons JOIN clf USING (code) GROUP BY 1, 2),
    best AS (SELECT index_code, sum(n) AS votes, max(n) AS top, arg_max(prefix, n * 100 - CAST(prefix AS INTEGER)) AS winner FROM votes GROUP BY 1)
    SELECT c.index_code, coalesce(CASE WHEN top / votes >= 0.6 THEN winner END, '') AS industry_code,
     CASE WHEN votes IS NULL THEN 'no_overlap' WHEN top / votes < 0.6 THEN 'ambiguous' ELSE '' END AS failure, CAST(coalesce(votes, 0) AS BIGINT) AS votes
    FROM (SELECT DISTINCT index_code FROM cons) c LEFT JOIN best b ON b.index_code = c.index_code""",
)
def bridge_vote(t):
    names = industry_names(t).select("l2_name", F.col("l3_code").alias("industry_code"))
    classification = (
        t.raw("supplier").where("s_acctbal > 0")
        .withColumn("l2_name", F.expr("'NATION_' || s_nationkey"))
        .join(names, "l2_name")
        .select(F.expr("lpad(CAST(s_suppkey AS STRING), 6, '0')").alias("code"), "industry_code")
    )
    constituents = t.raw("lineitem").selectExpr(
        "l_partkey * 50 + l_linenumber AS index_code", "lpad(CAST(l_suppkey AS STRING), 6, '0') AS code"
    ).distinct()
    voted = master.bridge_vote(constituents, classification, 2)
    return voted.select("index_code", text("industry_code"), text("failure"), "votes")
