"""Report identity (title key, broker, publish date), reference claims, soft delete and tags.

Hot keys: every per-key decision is a map-side combined aggregate joined back, so the rows of
one key are never sorted in one task and AQE can split the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_tag_name
from .numbering import consecutive_ids

IDENTITY = ["title_norm", "broker", "publish_date"]


def _with_new_ids(
    rows: DataFrame, order: str, taken: DataFrame, column: str, name: str, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Consecutive ids after the highest taken one, in ``order``."""
    first = taken.agg(F.coalesce(F.max(column), F.lit(0)) + 1).scalar()
    return consecutive_ids(rows, order, first, name, ties)


def merge_identities(files: DataFrame, live: DataFrame, ids: DataFrame) -> DataFrame:
    """Attach each incoming file to a report.

    ``ids``: every id ever given, deleted reports included, so that no new report takes one of
    theirs.

    ``files``: arrival, title, identity columns; ``live``: id, identity columns (unique).
    Files with one new identity make one report that shows the first title.
    """
    first = files.groupBy(*IDENTITY).agg(
        F.min("arrival").alias("first_arrival"), F.min_by("title", "arrival").alias("report_title")
    )
    known = first.join(live.select("id", *IDENTITY), IDENTITY, "left")
    old = known.where("id IS NOT NULL").withColumnRenamed("id", "report_id")
    new = _with_new_ids(
        known.where("id IS NULL").drop("id"), "first_arrival", ids, "id", "report_id", tuple(IDENTITY)
    )
    groups = old.withColumn("_was_live", F.lit(True)).unionByName(
        new.withColumn("_was_live", F.lit(False))
    )
    return (
        files.join(groups, IDENTITY)
        .withColumn("merged", F.col("_was_live") | (F.col("arrival") > F.col("first_arrival")))
        .drop("_was_live", "first_arrival")
    )


def claim_references(sightings: DataFrame, known: DataFrame) -> DataFrame:
    """``new`` for the first arrival of an unknown (connector, external id), else ``seen``."""
    key = ["connector_id", "external_id"]
    first = (
        sightings.groupBy(*key)
        .agg(F.min("arrival").alias("_first"))
        .join(known.select(*key), key, "left_anti")
    )
    return (
        sightings.join(first, key, "left")
        .withColumn(
            "claim", F.when(F.col("arrival") == F.col("_first"), "new").otherwise("seen")
        )
        .drop("_first")
    )


def dispose_references(refs: DataFrame, live: DataFrame, ids: DataFrame) -> DataFrame:
    """Status of newly claimed references, as if handled one by one in ``position`` order.

    live identity -> duplicate; else the first reference of the identity that can be fetched is
    ingested and later ones are its duplicates; the rest failed to fetch or waits (seen).
    ``ids`` as in ``merge_identities``.
    """
    joined = refs.join(
        live.select(*IDENTITY, F.col("id").alias("_live_id")), IDENTITY, "left"
    )
    can_fetch = F.col("auto_download") & F.col("fetch_ok") & F.col("_live_id").isNull()
    first = (
        joined.where(can_fetch).groupBy(*IDENTITY).agg(F.min("position").alias("_first"))
    )
    created = _with_new_ids(
        first, "_first", ids, "id", "_new_id", tuple(IDENTITY)
    )
    later = F.col("position") > F.col("_first")
    return (
        joined.join(created, IDENTITY, "left")
        .withColumn(
            "status",
            F.when(F.col("_live_id").isNotNull() | later, "duplicate")
            .when(F.col("position") == F.col("_first"), "ingested")
            .when(F.col("auto_download"), "fetch_failed")
            .otherwise("seen"),
        )
        .withColumn(
            "report_id",
            F.coalesce("_live_id", F.when(F.col("position") >= F.col("_first"), F.col("_new_id"))),
        )
        .drop("_live_id", "_first", "_new_id")
    )


def round_statistics(handled: DataFrame, round_key: list[str]) -> DataFrame:
    """Counts per subscription round. ``claim`` = seen/new, ``status`` for the new ones."""
    new = F.col("claim") == "new"
    is_new = lambda status: F.count_if(new & (F.col("status") == status))
    return handled.groupBy(*round_key).agg(
        F.count("*").alias("found"),
        F.count_if(new).alias("new"),
        F.count_if(~new).alias("seen"),
        is_new("duplicate").alias("duplicates"),
        is_new("ingested").alias("downloaded"),
        is_new("ingested").alias("ingested"),
        is_new("seen").alias("pending"),
        is_new("fetch_failed").alias("fetch_failed"),
    )


def manual_downloads(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome per reference, run-log rows).

    A reference already ingested or known as duplicate costs no quota; requests that repeat a
    reference inside the batch count once; if they differ, the least by its columns in order holds.
    """
    others = [c for c in requests.columns if c != "ref_id"]
    wanted = requests.groupBy("ref_id").agg(F.min(F.struct(*others)).alias("_r")).select("ref_id", "_r.*")
    outcome = wanted.withColumn(
        "outcome",
        F.when(F.col("status").isin("duplicate", "ingested"), "skipped")
        .when(F.col("fetch_ok"), "ingested")
        .otherwise("fetch_failed"),
    )
    log = outcome.where("outcome = 'ingested'").select(
        "connector_id",
        "subscription_id",
        F.lit("manual_download").alias("event"),
        F.lit(True).alias("ok"),
        F.concat(F.lit("manual download "), "external_id").alias("message"),
        F.create_map(F.lit("downloaded"), F.lit(1)).alias("stats"),
        "ref_id",
    )
    return outcome, log


def restore_eligibility(requests: DataFrame, reports: DataFrame, now: Column, days: int) -> DataFrame:
    """Verdict per requested report id; the checks apply in this order."""
    live = (
        reports.where("deleted_at IS NULL")
        .groupBy(*IDENTITY)
        .agg(F.lit(True).alias("_conflict"))
    )
    rows = reports.withColumnRenamed("id", "report_id").withColumn("_found", F.lit(True))
    return (
        requests.join(rows, "report_id", "left")
        .join(live, IDENTITY, "left")
        .withColumn(
            "verdict",
            F.when(F.col("_found").isNull(), "missing")
            .when(F.col("deleted_at").isNull(), "not_deleted")
            .when(now - F.col("deleted_at") > F.make_dt_interval(F.lit(days)), "window_passed")
            .when(F.col("_conflict"), "identity_live_again")
            .otherwise("ok"),
        )
        .drop("_found", "_conflict")
    )


def link_tags(
    requests: DataFrame, tags: DataFrame, links: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(new tags, new links) for tag requests (arrival, report_id, raw name).

    Tags are reused by normalised name; linking twice changes nothing; blank names are dropped.
    """
    named = requests.withColumn("name", normalize_tag_name(F.col("raw_name"))).where("name <> ''")
    first = named.groupBy("name").agg(F.min("arrival").alias("_first"))
    unknown = first.join(tags.select("name"), "name", "left_anti")
    new_tags = _with_new_ids(unknown, "_first", tags, "id", "id", ("name",)).select("id", "name")
    all_tags = tags.select("id", "name").unionByName(new_tags)
    new_links = (
        named.groupBy("report_id", "name")
        .agg(F.min("arrival").alias("arrival"))
        .join(all_tags, "name")
        .withColumnRenamed("id", "tag_id")
        .join(links.select("report_id", "tag_id"), ["report_id", "tag_id"], "left_anti")
    )
    return new_tags, new_links


def unlink_tags(requests: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """Links that remain after the unlink requests (report_id, raw name)."""
    gone = requests.select(
        "report_id", normalize_tag_name(F.col("raw_name")).alias("name")
    ).join(tags.select(F.col("id").alias("tag_id"), "name"), "name")
    return links.join(gone, ["report_id", "tag_id"], "left_anti")
