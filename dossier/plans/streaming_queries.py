"""Incremental jobs over the event log and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import discovery, runs
from .identity_queries import _CLAIM_SQL, _claims
from .registry import query
from .retrieval_queries import _SUMMARY, _WORDS
from .standins import BODIES, EVENTS, ctes, spark_columns

text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
_NOW = "2024-01-31 00:00:00"


def _stream(t, table, columns):
    """A test table as a file stream with the stand-in's columns."""
    rows = runs.table_stream(t.spark, f"{t.folder}/{table}.parquet", t.raw(table).schema)
    return rows.selectExpr(*spark_columns(columns))


def _arriving(t, rows, job, halves=2, files=3):
    """Run ``job`` on rows that arrive in two halves, in no order of time, one file a batch.

    The second run starts from the checkpoint of the first and finds the new files only.
    """
    folder, checkpoint = shared_folder(t.spark, "arrivals"), shared_folder(t.spark, "stream")
    half = F.pmod(F.xxhash64(*rows.columns), F.lit(halves))
    for n in range(halves):
        rows.where(half == n).repartition(files).write.mode("append").parquet(folder)
        result = job(runs.file_stream(t.spark, folder, "*.parquet", rows.schema, 1), checkpoint)
    return result


@query(
    "w1_discovery_window",
    ctes("log")
    + f""", c AS (SELECT subscription_id, max(CASE WHEN event = 'purchase' AND k < 30 THEN seen_at END) AS cursor FROM log GROUP BY 1)
    SELECT subscription_id, strftime(CASE WHEN cursor IS NULL THEN TIMESTAMP '{_NOW}' - INTERVAL 3 DAY ELSE greatest(cursor - INTERVAL 1 HOUR, TIMESTAMP '{_NOW}' - INTERVAL 7 DAY) END, '%Y-%m-%d %H:%M:%S') AS since FROM c""",
)
def discovery_window(t):
    cursors = t.log.groupBy("subscription_id").agg(
        F.max(F.expr("CASE WHEN event = 'purchase' AND k < 30 THEN seen_at END")).alias("cursor")
    )
    since = discovery.window_start(F.col("cursor"), F.lit(_NOW).cast("timestamp_ntz"))
    return cursors.select("subscription_id", F.date_format(since, "yyyy-MM-dd HH:mm:ss").alias("since"))


@query(
    "w2_cursor_advance",
    ctes("log")
    + _CLAIM_SQL
    + """, subs AS (SELECT subscription_id, CASE WHEN subscription_id > 75 THEN TIMESTAMP '2024-01-25' END AS cursor FROM log GROUP BY 1),
    newest AS (SELECT c.subscription_id, max(l.seen_at) AS m FROM claims c JOIN log l ON l.event_id = c.arrival WHERE claim = 'new' GROUP BY 1)
    SELECT subscription_id, coalesce(strftime(greatest(cursor, m), '%Y-%m-%d %H:%M:%S'), '') AS cursor FROM subs LEFT JOIN newest USING (subscription_id)""",
)
def cursor_advance(t):
    subscriptions = t.log.select("subscription_id").distinct().withColumn(
        "cursor", F.when(F.col("subscription_id") > 75, F.lit("2024-01-25").cast("timestamp_ntz"))
    )
    times = t.log.select(F.col("event_id").alias("arrival"), F.col("seen_at").alias("published_at"))
    handled = _claims(t).join(times, "arrival")
    moved = discovery.advance_cursors(subscriptions, handled)
    return moved.select(
        "subscription_id", F.coalesce(F.date_format("cursor", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("cursor")
    )


@query(
    "w2_cursor_stream",
    ctes("log") + " SELECT subscription_id, strftime(max(seen_at), '%Y-%m-%d %H:%M:%S') AS cursor FROM log GROUP BY 1",
)
def cursor_stream(t):
    """The running maximum over a stream of new references."""
    rows = t.log.select("subscription_id", F.col("seen_at").alias("published_at"))
    state = shared_folder(t.spark, "cursors")
    moved = _arriving(t, rows, lambda stream, checkpoint: discovery.running_cursors(stream, state, checkpoint, every=4))
    return moved.select("subscription_id", F.date_format("cursor", "yyyy-MM-dd HH:mm:ss").alias("cursor"))


_REF = ["event AS connector_id", "CAST(subscription_id * 100 + k AS STRING) AS external_id", "event_id AS arrival"]


@query(
    "w3_first_sightings",
    ctes("log") + " SELECT event AS connector_id, CAST(subscription_id * 100 + k AS VARCHAR) AS external_id, min(event_id) AS arrival, count(*) AS sightings FROM log GROUP BY 1, 2",
)
def first_sightings(t):
    state = shared_folder(t.spark, "sightings")
    seen = _arriving(t, t.log.selectExpr(*_REF), lambda stream, checkpoint: discovery.first_sightings(stream, state, checkpoint, every=4))
    return seen.select("connector_id", "external_id", "arrival", "sightings")


# every event but a purchase counts as a failed round, so that dead letters and alerts occur
_FAILED = "event <> 'purchase'"
_STREAK_SQL = f""", r AS (SELECT event_id, subscription_id, seen_at, {_FAILED} AS failed, row_number() OVER (PARTITION BY subscription_id ORDER BY seen_at, event_id) AS rn FROM log),
 s AS (SELECT *, rn - coalesce(max(CASE WHEN NOT failed THEN rn END) OVER (PARTITION BY subscription_id ORDER BY rn), 0) AS streak FROM r),
 st AS (SELECT *, CASE WHEN streak = 0 THEN 'run' WHEN streak % 4 = 0 THEN 'dead_letter' ELSE 'retry' END AS event FROM s)"""
_STATE = "event_id, event, CAST(streak % 4 AS INTEGER) AS attempt, CAST(streak // 4 AS INTEGER) AS consecutive_failures, streak > 0 AND streak % 20 = 0 AS alert"


def _rounds(log):
    return log.select("event_id", "subscription_id", "seen_at", F.expr(_FAILED).alias("failed"))


@query("w4_retry_states", ctes("log") + _STREAK_SQL + f" SELECT {_STATE} FROM st")
def retry_states(t):
    return discovery.retry_states(_rounds(t.log)).select("event_id", "event", "attempt", "consecutive_failures", "alert")


@query("w4_retry_stream", ctes("log") + _STREAK_SQL + f" SELECT {_STATE} FROM st")
def retry_stream(t):
    rounds = _rounds(_stream(t, "events", EVENTS))
    states = discovery.retry_stream(rounds, shared_folder(t.spark, "retries"))
    return states.select("event_id", "event", "attempt", "consecutive_failures", "alert")


@query(
    "w5_next_run",
    ctes("log")
    + _STREAK_SQL
    + """ SELECT event_id, strftime(seen_at + to_seconds(CASE WHEN event = 'retry' THEN CASE streak % 4 WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 1500 END ELSE 6 * 3600 END), '%Y-%m-%d %H:%M:%S') AS next_run_at FROM st""",
)
def next_run(t):
    states = discovery.retry_states(_rounds(t.log))
    at = discovery.next_run(F.col("event"), F.col("attempt"), F.col("seen_at"), F.lit(6))
    return states.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("next_run_at"))


@query(
    "w6_daily_quota",
    ctes("log") + " SELECT CAST(day AS VARCHAR) AS day, CAST(sum(k) AS BIGINT) AS downloads FROM log GROUP BY 1",
)
def daily_quota(t):
    rounds = t.log.select(F.col("seen_at").cast("timestamp").alias("seen_at"), "k")
    state = shared_folder(t.spark, "quota")
    days = _arriving(t, rounds, lambda stream, checkpoint: discovery.daily_quota(stream, "seen_at", "k", state, checkpoint))
    return days.withColumn("day", F.col("day").cast("string"))


_CLEANED = r"""array_to_string(list_filter(regexp_split_to_array(body, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
  lambda x: NOT regexp_matches(trim(x, ' ' || chr(9)), '^[-—]*\s*\d+\s*[-—]*$|^\(?\d{4}[ /年]\d{1,2}[ /月]\d{1,2}[日)]?.{0,10}$')
  AND NOT (regexp_full_match(trim(x, ' ' || chr(9)), '[\d\s%.\-]+') AND length(trim(x, ' ' || chr(9))) < 20)), chr(10))"""


@query(
    "w7_body_index",
    ctes("bodies")
    + rf""", ok AS (SELECT doc_id, title, {_CLEANED} AS body, {_SUMMARY} AS summary FROM bodies WHERE length(regexp_replace(body, '^\s+|\s+$', '', 'g')) >= 200),
    w AS (SELECT doc_id AS report_id, 'A' AS field, unnest({_WORDS.format('title')}) AS token FROM ok UNION ALL SELECT doc_id, 'B', unnest({_WORDS.format('body')}) FROM ok
      UNION ALL SELECT doc_id, 'C', unnest({_WORDS.format('summary')}) FROM ok)
    SELECT report_id, field, count(*) AS occurrences, count(DISTINCT token) AS postings FROM w GROUP BY 1, 2""",
)
def body_index(t):
    bodies = _stream(t, "documents", BODIES).select(
        F.col("doc_id").alias("report_id"), "title", "body", F.expr(_SUMMARY).alias("summary")
    )
    folder = shared_folder(t.spark, "body-index")
    discovery.index_bodies(bodies, folder)
    index = discovery.current_postings(t.spark, folder)
    return index.groupBy("report_id", "field").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("postings"))
