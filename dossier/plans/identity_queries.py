"""Identity, claims, dispositions, soft delete, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import normalize_title
from ..operators import identity
from ..session import cut_lineage
from .registry import query
from .standins import ctes

# documents as incoming files; the labelled ones are already live reports
_FILES_SQL = r"""files AS (SELECT doc_id AS arrival, title, regexp_replace(replace(lower(title), 'ß', 'ss'), '\s+', '', 'g') AS title_norm, broker,
   DATE '2024-01-01' + CAST(length(title) % 28 AS INTEGER) AS publish_date FROM bodies),
 live AS (SELECT min(arrival) AS id, title_norm, broker, publish_date FROM files JOIN labels ON arrival = labels.doc_id GROUP BY 2, 3, 4)"""


def _files(t):
    return t.bodies.select(
        F.col("doc_id").alias("arrival"),
        "title",
        normalize_title(F.col("title")).alias("title_norm"),
        "broker",
        F.expr("date_add(DATE '2024-01-01', CAST(length(title) % 28 AS INT))").alias("publish_date"),
    )


def _live(t, files):
    labelled = t.raw("labels").select(F.col("doc_id").alias("arrival"))
    return (
        files.join(labelled, "arrival", "left_semi")
        .groupBy(*identity.IDENTITY)
        .agg(F.min("arrival").alias("id"))
    )


@query(
    "d1_identity_merge",
    ctes("bodies")
    + f""", {_FILES_SQL},
  firsts AS (SELECT title_norm, broker, publish_date, min(arrival) AS f, arg_min(title, arrival) AS report_title FROM files GROUP BY 1, 2, 3),
  fresh AS (SELECT f.*, (SELECT max(id) FROM live) + row_number() OVER (ORDER BY f) AS id FROM firsts f
    WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.title_norm = f.title_norm AND l.broker = f.broker AND l.publish_date = f.publish_date))
  SELECT x.arrival, coalesce(l.id, n.id) AS report_id, l.id IS NOT NULL OR x.arrival > f.f AS merged, md5(f.report_title) AS title_md5
  FROM files x JOIN firsts f USING (title_norm, broker, publish_date)
  LEFT JOIN live l USING (title_norm, broker, publish_date) LEFT JOIN fresh n USING (title_norm, broker, publish_date)""",
)
def identity_merge(t):
    # landing stores the identity key next to the file
    files = cut_lineage(_files(t), "landed")
    live = _live(t, files)
    merged = identity.merge_identities(files, live, live)
    return merged.select(
        "arrival", "report_id", "merged", F.md5(F.col("report_title").cast("binary")).alias("title_md5")
    )


_SIGHTINGS = {
    "arrival": "event_id",
    "connector_id": "event",
    "external_id": "CAST(subscription_id * 100 + k AS VARCHAR(20))",
    "subscription_id": "subscription_id",
    "day": "day",
    "title": "event || ' r' || CAST(k AS VARCHAR(9))",
    "title_norm": "event || 'r' || CAST(k AS VARCHAR(9))",
    "broker": "'Desk ' || CAST(subscription_id % 5 AS VARCHAR(9))",
    "publish_date": "day",
    "auto_download": "amount >= 10",
    "fetch_ok": "k < 80",
}
_S_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _SIGHTINGS.items()) + " FROM log"
# what the first days brought is the stored state, the rest arrives as a batch
_OLD = "day < DATE '2024-01-08'"


def _sightings(t):
    return t.log.selectExpr(*[f"{e} AS {c}" for c, e in _SIGHTINGS.items()])


def _claims(t):
    all_rows = _sightings(t)
    known = all_rows.where(_OLD).select("connector_id", "external_id").distinct()
    return identity.claim_references(all_rows.where(f"NOT ({_OLD})"), known)


_CLAIM_SQL = f""", sight AS ({_S_SQL}), known AS (SELECT DISTINCT connector_id, external_id FROM sight WHERE {_OLD}),
 claims AS (SELECT s.*, CASE WHEN NOT EXISTS (SELECT 1 FROM known k WHERE k.connector_id = s.connector_id AND k.external_id = s.external_id)
   AND row_number() OVER (PARTITION BY connector_id, external_id ORDER BY arrival) = 1 THEN 'new' ELSE 'seen' END AS claim
   FROM sight s WHERE NOT ({_OLD}))"""


@query("d2_reference_claim", ctes("log") + _CLAIM_SQL + " SELECT arrival, claim FROM claims")
def reference_claim(t):
    return _claims(t).select("arrival", "claim")


def _live_refs(t):
    """Identities of stored reports: what every third day of the stored period printed."""
    return (
        _sightings(t)
        .withColumn("publish_date", F.date_add("day", 9))
        .where(_OLD)
        .groupBy(*identity.IDENTITY)
        .agg(F.min("arrival").alias("id"))
    )


def _handled(t):
    claims, live = _claims(t), _live_refs(t)
    new = identity.dispose_references(
        claims.where("claim = 'new'").withColumnRenamed("arrival", "position"), live, live
    )
    return claims, new


_DISPOSE_SQL = (
    _CLAIM_SQL
    + f""", liverefs AS (SELECT title_norm, broker, CAST(day + 9 AS DATE) AS publish_date, min(arrival) AS id FROM sight WHERE {_OLD} GROUP BY 1, 2, 3),
 cand AS (SELECT c.*, l.id AS live_id FROM claims c LEFT JOIN liverefs l USING (title_norm, broker, publish_date) WHERE claim = 'new'),
 marked AS (SELECT *, min(CASE WHEN auto_download AND fetch_ok AND live_id IS NULL THEN arrival END) OVER (PARTITION BY title_norm, broker, publish_date) AS first_pos FROM cand),
 created AS (SELECT first_pos, (SELECT max(id) FROM liverefs) + row_number() OVER (ORDER BY first_pos) AS new_id FROM (SELECT DISTINCT first_pos FROM marked WHERE first_pos IS NOT NULL)),
 handled AS (SELECT m.*, CASE WHEN live_id IS NOT NULL OR arrival > m.first_pos THEN 'duplicate' WHEN arrival = m.first_pos THEN 'ingested'
   WHEN auto_download THEN 'fetch_failed' ELSE 'seen' END AS status,
   coalesce(live_id, CASE WHEN arrival >= m.first_pos THEN new_id END, -1) AS report_id FROM marked m LEFT JOIN created c ON c.first_pos = m.first_pos)"""
)


@query(
    "d3_reference_disposition",
    ctes("log") + _DISPOSE_SQL + " SELECT arrival AS position, status, report_id FROM handled",
)
def reference_disposition(t):
    _, new = _handled(t)
    return new.select("position", "status", F.coalesce("report_id", F.lit(-1)).alias("report_id"))


@query(
    "d4_round_statistics",
    ctes("log")
    + _DISPOSE_SQL
    + """ SELECT c.subscription_id, CAST(c.day AS VARCHAR) AS day, count(*) AS found, count(*) FILTER (c.claim = 'new') AS new,
      count(*) FILTER (c.claim = 'seen') AS seen, count(*) FILTER (h.status = 'duplicate') AS duplicates,
      count(*) FILTER (h.status = 'ingested') AS downloaded, count(*) FILTER (h.status = 'ingested') AS ingested,
      count(*) FILTER (h.status = 'seen') AS pending, count(*) FILTER (h.status = 'fetch_failed') AS fetch_failed
      FROM claims c LEFT JOIN handled h ON h.arrival = c.arrival GROUP BY 1, 2""",
)
def round_statistics(t):
    claims, new = _handled(t)
    # new references carry their status; the others were only seen again
    handled = new.select("subscription_id", "day", "claim", "status").unionByName(
        claims.where("claim = 'seen'").select(
            "subscription_id", "day", "claim", F.lit(None).cast("string").alias("status")
        )
    )
    stats = identity.round_statistics(handled, ["subscription_id", "day"])
    return stats.withColumn("day", F.col("day").cast("string"))


@query(
    "d5_manual_download",
    ctes("log")
    + _DISPOSE_SQL
    + """, done AS (SELECT *, CASE WHEN status IN ('duplicate', 'ingested') THEN 'skipped' WHEN fetch_ok THEN 'ingested' ELSE 'fetch_failed' END AS outcome FROM handled)
    SELECT arrival AS ref_id, 'outcome' AS kind, outcome AS what, 0 AS downloaded FROM done
    UNION ALL SELECT arrival, 'log', 'manual download ' || external_id, 1 FROM done WHERE outcome = 'ingested'""",
)
def manual_download(t):
    _, new = _handled(t)
    refs = new.withColumnRenamed("position", "ref_id")
    # every reference is requested, each one twice
    outcome, log = identity.manual_downloads(refs.unionByName(refs))
    return outcome.select(
        "ref_id", F.lit("outcome").alias("kind"), F.col("outcome").alias("what"), F.lit(0).alias("downloaded")
    ).unionByName(
        log.select(
            "ref_id", F.lit("log").alias("kind"), F.col("message").alias("what"), F.col("stats")["downloaded"].alias("downloaded")
        )
    )


@query(
    "d6_restore_eligibility",
    ctes("reports")
    + """, keyed AS (SELECT *, CASE WHEN deleted THEN publish_date + CAST(author_id % 60 AS INTEGER) END AS deleted_on FROM reports)
     SELECT q.report_id, CASE WHEN r.id IS NULL THEN 'missing' WHEN r.deleted_on IS NULL THEN 'not_deleted'
       WHEN DATE '2001-08-10' - r.deleted_on > 30 * 40 THEN 'window_passed'
       WHEN EXISTS (SELECT 1 FROM keyed o WHERE o.deleted_on IS NULL AND o.title = r.title AND o.broker = r.broker AND o.publish_date = r.publish_date)
       THEN 'identity_live_again' ELSE 'ok' END AS verdict
     FROM (SELECT id AS report_id FROM reports UNION ALL SELECT -1 - c_custkey FROM customer) q LEFT JOIN keyed r ON r.id = q.report_id""",
)
def restore_eligibility(t):
    """A window of 1 200 days suits the six years of the test dates."""
    reports = t.reports.select(
        "id",
        normalize_title(F.col("title")).alias("title_norm"),
        "broker",
        "publish_date",
        F.expr(
            "CASE WHEN deleted THEN CAST(date_add(publish_date, CAST(author_id % 60 AS INT)) AS TIMESTAMP) END"
        ).alias("deleted_at"),
    )
    requests = reports.select(F.col("id").alias("report_id")).unionByName(
        t.raw("customer").selectExpr("-1 - c_custkey AS report_id")
    )
    now = F.lit("2001-08-10").cast("timestamp")
    verdicts = identity.restore_eligibility(requests, reports, now, K.RESTORE_DAYS * 40)
    return verdicts.select("report_id", "verdict")


def _tag_requests(t):
    """Documents ask for a tag; tags of labelled documents exist, links of good ones too."""
    docs = t.raw("documents")
    requests = docs.select(
        F.col("doc_id").alias("arrival"),
        F.col("doc_id").alias("report_id"),
        F.concat(F.lit(" "), "source", F.lit(" \t"), "lang").alias("raw_name"),
    )
    labelled = docs.join(t.raw("labels"), "doc_id").select(
        "doc_id", "quality", F.concat_ws(" ", "source", "lang").alias("name")
    )
    tags = labelled.groupBy("name").agg(F.min("doc_id").alias("id"))
    links = (
        labelled.where("quality = 1")
        .join(tags, "name")
        .select(F.col("doc_id").alias("report_id"), F.col("id").alias("tag_id"))
    )
    return requests, tags, links


@query(
    "d7_tag_link",
    """WITH req AS (SELECT doc_id AS arrival, doc_id AS report_id, source || ' ' || lang AS name FROM documents),
    tags AS (SELECT min(r.arrival) AS id, name FROM req r JOIN labels l ON l.doc_id = r.arrival GROUP BY name),
    fresh AS (SELECT name, (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY min(arrival)) AS id FROM req WHERE name NOT IN (SELECT name FROM tags) GROUP BY name)
    SELECT r.report_id, a.id AS tag_id, r.name FROM req r JOIN (SELECT id, name FROM tags UNION ALL SELECT id, name FROM fresh) a ON a.name = r.name
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.report_id AND l.quality = 1)""",
)
def tag_link(t):
    _, new_links = identity.link_tags(*_tag_requests(t))
    return new_links.select("report_id", "tag_id", "name")


@query(
    "d7_new_tags",
    """WITH req AS (SELECT doc_id AS arrival, source || ' ' || lang || ' ' || CAST(n_chars // 1000 AS VARCHAR) AS name FROM documents),
    tags AS (SELECT min(r.arrival) AS id, name FROM req r JOIN labels l ON l.doc_id = r.arrival WHERE l.quality = 1 GROUP BY name)
    SELECT name, (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY min(arrival)) AS id FROM req
    WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM tags WHERE name IS NOT NULL) GROUP BY name""",
)
def new_tags(t):
    """Tag rows that the requests create: names by source, language and length that no good document has."""
    docs = t.raw("documents").withColumn("size", F.expr("CAST(n_chars DIV 1000 AS STRING)"))
    requests = docs.select(
        F.col("doc_id").alias("arrival"),
        F.col("doc_id").alias("report_id"),
        F.concat(F.lit("\t"), "source", F.lit("  "), "lang", F.lit(" "), "size", F.lit(" ")).alias("raw_name"),
    )
    name = F.concat("source", F.lit(" "), "lang", F.lit(" "), "size").alias("name")
    good = docs.join(t.raw("labels").where("quality = 1").select("doc_id"), "doc_id").select("doc_id", name)
    tags = good.groupBy("name").agg(F.min("doc_id").alias("id"))
    links = good.join(tags, "name").select(F.col("doc_id").alias("report_id"), F.col("id").alias("tag_id"))
    created, _ = identity.link_tags(requests, tags, links)
    return created.select("name", "id")


@query(
    "d7_tag_unlink",
    """WITH docs AS (SELECT doc_id, source || ' ' || lang AS name, source FROM documents WHERE source || ' ' || lang IS NOT NULL),
    tags AS (SELECT name, min(doc_id) AS id FROM docs GROUP BY name),
    req AS (SELECT l.doc_id AS report_id, CASE WHEN toxic = 1 THEN source ELSE name END AS name FROM labels l JOIN docs d ON d.doc_id = l.doc_id WHERE quality = 0)
    SELECT d.doc_id AS report_id, g.id AS tag_id FROM docs d JOIN tags g ON g.name = d.name
    WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.report_id = d.doc_id AND r.name = d.name)""",
)
def tag_unlink(t):
    """Every document is linked with its tag; poor ones ask to be unlinked, toxic ones by a name no tag has."""
    docs = t.raw("documents").where("source is not null and lang is not null")
    docs = docs.select("doc_id", "source", F.concat("source", F.lit(" "), "lang").alias("name"))
    tags = docs.groupBy("name").agg(F.min("doc_id").alias("id"))
    links = docs.join(tags, "name").select(F.col("doc_id").alias("report_id"), F.col("id").alias("tag_id"))
    requests = t.raw("labels").where("quality = 0").join(docs, "doc_id").select(
        F.col("doc_id").alias("report_id"),
        F.concat(F.lit(" "), F.when(F.col("toxic") == 1, F.col("source")).otherwise(F.regexp_replace("name", " ", "  "))).alias("raw_name"),
    )
    return identity.unlink_tags(requests, tags, links).select("report_id", "tag_id")
