"""Read views: lists, details, queues and lookups over the current state of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc


def page(rows: DataFrame, order: list[Column], limit: int, offset: int, cap: int) -> DataFrame:
    """One page in a total order; limit and offset are clamped like the list endpoints do."""
    limit = max(1, min(limit, cap))
    return rows.orderBy(*order).offset(max(0, offset)).limit(limit)


def live_reports(reports: DataFrame) -> DataFrame:
    return reports.where(~F.col("deleted"))


def current_links(links: DataFrame, reports: DataFrame, *columns: str) -> DataFrame:
    """Links of the analysis version each live report points at, with the named report columns."""
    heads = (
        live_reports(reports)
        .where("current_analysis_id IS NOT NULL")
        .select(F.col("id").alias("report_id"), F.col("current_analysis_id").alias("analysis_id"), *columns)
    )
    return links.join(heads, ["report_id", "analysis_id"])


def current_bodies(files: DataFrame) -> DataFrame:
    """The most recently converted file per report; the text is joined back, not shuffled twice."""
    newest = (
        files.where("converted_at IS NOT NULL")
        .groupBy("report_id")
        .agg(F.max(F.struct("converted_at", "file_id")).alias("m"))
        .select("report_id", "m.file_id")
    )
    return files.join(newest, ["report_id", "file_id"], "left_semi")


def latest_uploads(files: DataFrame) -> DataFrame:
    """The file uploaded last per report: the highest id, converted or not."""
    return files.groupBy("report_id").agg(F.max("file_id").alias("file_id"))


def report_list(
    reports: DataFrame,
    *,
    broker: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    theme_links: DataFrame | None = None,
    matching: DataFrame | None = None,
) -> DataFrame:
    """Live reports under the given filters. ``theme_links`` are current links of one theme,
    ``matching`` the report ids a text query found; order and page come from :func:`page`."""
    rows = live_reports(reports)
    if broker:
        rows = rows.where(F.col("broker") == broker)
    if date_from:
        rows = rows.where(F.col("publish_date") >= F.lit(date_from).cast("date"))
    if date_to:
        rows = rows.where(F.col("publish_date") <= F.lit(date_to).cast("date"))
    for other in (theme_links, matching):
        if other is not None:
            rows = rows.join(other, F.col("id") == other["report_id"], "left_semi")
    return rows


def newest_first() -> list[Column]:
    return [F.desc("publish_date"), F.desc("id")]


def report_targets(links: DataFrame, reports: DataFrame, master: DataFrame, matches: DataFrame) -> DataFrame:
    """Current target links with master data and the state of their review."""
    return (
        current_links(links, reports)
        .join(master, "target_code", "left")
        .join(matches, "match_id", "left")
    )


def target_search(master: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Code prefix, or part of the name or of the normalised name; unnamed rows never show."""
    hit = F.col("code").startswith(needle) | F.col("name").contains(needle) | F.col("name_norm").contains(needle)
    return page(master.where(hit & (F.col("name") != "")), [F.col("code")], limit, 0, 50)


def theme_reports(links: DataFrame, reports: DataFrame, *columns: str) -> DataFrame:
    """Distinct (theme, report) pairs over current versions with the named report columns.

    The columns depend on the report alone, so one join brings them and the distinct stays exact.
    """
    joined = current_links(links.select("report_id", "analysis_id", "theme_id"), reports, *columns)
    return joined.select("theme_id", "report_id", *columns).distinct()


def theme_members(members: DataFrame, master: DataFrame, active_only: bool = False) -> DataFrame:
    rows = members.where("is_active") if active_only else members
    return rows.join(master, "target_code").orderBy("theme_id", F.desc("is_active"), "target_code")


def theme_list(
    themes: DataFrame,
    report_counts: DataFrame,
    member_counts: DataFrame,
    *,
    status: str = "active",
    needle: str | None = None,
) -> DataFrame:
    """Vocabulary with counts. Only U+0020 is removed from names and the needle, nothing from
    synonyms; the search ignores case."""
    rows = themes if status == "all" else themes.where(F.col("status") == status)
    if needle:
        plain = F.lower(F.replace(nfkc(F.lit(needle)), F.lit(" "), F.lit("")))
        text = F.concat(
            F.replace(nfkc(F.col("name")), F.lit(" "), F.lit("")),
            nfkc(F.array_join(F.coalesce("synonyms", F.array().cast("array<string>")), "")),
        )
        rows = rows.where(F.lower(text).contains(plain))
    counted = rows.join(
        report_counts.withColumnRenamed("theme_id", "id"), "id", "left"
    ).join(member_counts.withColumnRenamed("theme_id", "id"), "id", "left")
    return counted.withColumn(
        "report_count", F.coalesce("report_count", F.lit(0))
    ).withColumn("member_count", F.coalesce("member_count", F.lit(0)))


def pending_queue(matches: DataFrame, reports: DataFrame) -> DataFrame:
    """Open review rows with the report title, newest first."""
    return (
        matches.where("status = 'pending'")
        .join(reports.select(F.col("id").alias("report_id"), "title"), "report_id")
        .orderBy(F.desc("created_at"), F.desc("match_id"))
    )


def version_history(versions: DataFrame, reports: DataFrame) -> DataFrame:
    """All versions of live reports with a head flag, newest first per report."""
    heads = live_reports(reports).select(F.col("id").alias("report_id"), "current_analysis_id")
    return (
        versions.join(heads, "report_id")
        .withColumn("is_head", F.coalesce(F.col("analysis_id") == F.col("current_analysis_id"), F.lit(False)))
        .orderBy("report_id", F.desc("version"))
    )


def visible_references(
    refs: DataFrame, subscriptions: DataFrame, *, user: int | None, status: str | None = None
) -> DataFrame:
    """References an analyst may see: those found by own subscriptions; ``user=None`` sees all."""
    rows = refs
    if user is not None:
        own = subscriptions.where(F.col("created_by") == user).select("subscription_id")
        rows = rows.join(own, "subscription_id", "left_semi")
    if status:
        rows = rows.where(F.col("status") == status)
    return rows


def run_log(log: DataFrame, *, event: str | None = None, subscription: int | None = None) -> DataFrame:
    rows = log
    if event:
        rows = rows.where(F.col("event") == event)
    if subscription is not None:
        rows = rows.where(F.col("subscription_id") == subscription)
    return rows


def due_subscriptions(subscriptions: DataFrame, now: Column) -> DataFrame:
    return subscriptions.where(F.col("enabled") & (F.col("next_run_at") <= now)).orderBy("subscription_id")


def subscriptions_with_theme(subscriptions: DataFrame, themes: DataFrame) -> DataFrame:
    names = themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme_name"))
    return subscriptions.join(names, "theme_id", "left").withColumn(
        "theme_name", F.coalesce("theme_name", F.concat(F.lit("#"), F.col("theme_id").cast("string")))
    )


def latest_synthesis(syntheses: DataFrame) -> DataFrame:
    return (
        syntheses.groupBy("theme_id")
        .agg(F.max_by(F.struct("synthesis_id", "version", "created_at"), "version").alias("s"))
        .select("theme_id", "s.*")
    )


def theme_detail(
    themes: DataFrame, report_counts: DataFrame, member_counts: DataFrame, syntheses: DataFrame
) -> DataFrame:
    """Every theme with both counts and its latest synthesis."""
    latest = latest_synthesis(syntheses).withColumnRenamed("theme_id", "id")
    return theme_list(themes, report_counts, member_counts, status="all").join(latest, "id", "left")


def report_detail(reports: DataFrame, files: DataFrame, tags: DataFrame) -> DataFrame:
    """Live reports with one row per file or tag, in display order inside each kind.

    Long form: a report with very many files or tags never becomes one huge row.
    """
    live = live_reports(reports)
    with_files = live.join(files.select(F.col("report_id").alias("id"), F.lit("file").alias("part"), F.col("file_id").alias("position"), F.col("filename").alias("value")), "id")
    with_tags = live.join(tags.select(F.col("report_id").alias("id"), F.lit("tag").alias("part"), "position", F.col("tag").alias("value")), "id")
    bare = live.withColumn("part", F.lit("report")).withColumn("position", F.lit(0)).withColumn("value", F.col("title"))
    return bare.unionByName(with_files).unionByName(with_tags)
