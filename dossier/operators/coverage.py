"""Counts and coverage over current versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered_within
from .views import current_links


def reports_per_theme(links: DataFrame, reports: DataFrame) -> DataFrame:
    """Distinct live reports whose current version names the theme (two-step count, no hot group)."""
    pairs = current_links(links.select("report_id", "analysis_id", "theme_id"), reports)
    return pairs.groupBy("theme_id").agg(F.countDistinct("report_id").alias("report_count"))


def active_members(members: DataFrame) -> DataFrame:
    return members.where("is_active").groupBy("theme_id").agg(F.count("*").alias("member_count"))


def author_search(authors: DataFrame, reports: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Authors by part of the name with their brokers, most reports first."""
    named = current_links(authors.where(F.col("name").contains(needle)), reports, "broker")
    return (
        named.groupBy("name", "cert", "broker")
        .agg(F.countDistinct("report_id").alias("report_count"))
        .orderBy(F.desc("report_count"), "name", F.asc_nulls_first("cert"), "broker")
        .limit(limit)
    )


def author_reports(
    authors: DataFrame, reports: DataFrame, name: str, cert: str | None = None, broker: str | None = None
) -> DataFrame:
    rows = current_links(authors.where(F.col("name") == name), reports, "broker")
    if cert:
        rows = rows.where(F.col("cert") == cert)
    if broker:
        rows = rows.where(F.col("broker") == broker)
    return rows.select("report_id").distinct()


def coverage(links: DataFrame, reports: DataFrame, author: DataFrame, key: str) -> DataFrame:
    """(key, report) pairs of an author's reports with the number of reports per key.

    Long form; the display order is (-reports, key, newest report first).
    """
    pairs = (
        current_links(links, reports)
        .join(author, "report_id", "left_semi")
        .where(F.col(key).isNotNull())
        .select(key, "report_id")
        .distinct()
    )
    counts = pairs.groupBy(key).agg(F.count("*").alias("reports"))
    return pairs.join(counts, key)


def downloads(log: DataFrame, today: Column) -> DataFrame:
    """(today, total) downloads as logged; rows without the statistic count nothing."""
    n = F.try_variant_get(F.try_parse_json("stats"), "$.downloaded", "bigint")
    return log.agg(
        F.coalesce(F.sum(F.when(F.col("seen_at") >= today, n)), F.lit(0)).alias("downloads_today"),
        F.coalesce(F.sum(n), F.lit(0)).alias("downloads_total"),
    )


def tags_in_order(links: DataFrame) -> DataFrame:
    """Position of each tag in its report: by link time, then tag id."""
    return numbered_within(
        links,
        ["report_id"],
        [F.col("created_at"), F.col("tag_id")],
        "position",
    )
