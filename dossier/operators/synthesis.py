"""Data side of cross-report synthesis: evidence, fingerprints, digests, citations, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.fields import normalize_code
from ..functions.text import strip
from .extraction import objects
from .views import theme_reports


def select_evidence(links: DataFrame, reports: DataFrame, limit: int = K.EVIDENCE_REPORTS) -> DataFrame:
    """(theme_id, position, report_id, total, truncated): the newest reports of every theme.

    The rank filter cuts each theme before the shuffle, the total comes from a two-step count,
    so a theme with a third of all reports costs no single task.
    """
    pairs = theme_reports(links, reports, "publish_date")
    newest = W.partitionBy("theme_id").orderBy(F.desc("publish_date"), F.desc("report_id"))
    chosen = pairs.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)
    totals = pairs.groupBy("theme_id").agg(F.count("*").alias("total"))
    return chosen.join(totals, "theme_id").select(
        "theme_id", "position", "report_id", "total", (F.col("total") > limit).alias("truncated")
    )


def fingerprint(evidence: DataFrame) -> DataFrame:
    """sha256 of the compact JSON list of the sorted ids, per theme (at most one evidence set)."""
    ids = F.array_sort(F.collect_list("report_id"))
    return evidence.groupBy("theme_id").agg(
        F.sha2(
            F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ","), F.lit("]")), 256
        ).alias("input_fingerprint"),
        F.count("*").alias("n_reports"),
    )


def cache_decision(
    requests: DataFrame, themes: DataFrame, fingerprints: DataFrame, syntheses: DataFrame
) -> DataFrame:
    """missing / unavailable / empty / cached / recompute per request (theme_id, force)."""
    latest = syntheses.groupBy("theme_id").agg(
        F.max_by(F.struct("version", "input_fingerprint"), "version").alias("_latest")
    )
    state = themes.select(F.col("id").alias("theme_id"), F.col("status").alias("_status"))
    same = F.col("_latest.input_fingerprint") == F.col("input_fingerprint")
    return (
        requests.join(state, "theme_id", "left")
        .join(fingerprints, "theme_id", "left")
        .join(latest, "theme_id", "left")
        .withColumn(
            "decision",
            F.when(F.col("_status").isNull(), "missing")
            .when(F.col("_status").isin("merged", "retired"), "unavailable")
            .when(F.col("input_fingerprint").isNull(), "empty")
            .when(~F.col("force") & F.coalesce(same, F.lit(False)), "cached")
            .otherwise("recompute"),
        )
        .withColumn("cached_version", F.when(F.col("decision") == "cached", F.col("_latest.version")))
        .drop("_status", "_latest")
    )


def revalidate(snapshots: DataFrame, reports: DataFrame) -> DataFrame:
    """(theme_id, position, report_id) of a stored id list, without members that were deleted or
    lost their analysis; order kept, positions without gaps. A list holds one evidence set."""
    usable = reports.where("NOT deleted AND current_analysis_id IS NOT NULL").select(
        F.col("id").alias("report_id")
    )
    kept = (
        snapshots.select("theme_id", F.posexplode("report_ids").alias("_pos", "report_id"))
        .join(usable, "report_id", "left_semi")
    )
    order = W.partitionBy("theme_id").orderBy("_pos")
    return kept.select("theme_id", F.row_number().over(order).alias("position"), "report_id")


def report_blocks(reports: DataFrame, analyses: DataFrame, links: DataFrame) -> DataFrame:
    """What a digest says about a report, built once per report: (report_id, header, details).

    ``analyses``: analysis_id, summary, action; ``links``: analysis_id, seq, raw_name,
    target_code, stance. Only links of the head version are gathered, per report.
    """
    heads = reports.where("current_analysis_id IS NOT NULL").select(
        F.col("id").alias("report_id"), F.col("current_analysis_id").alias("analysis_id")
    )
    label = F.when(
        F.col("target_code").isNotNull(),
        F.concat("raw_name", F.lit("("), "target_code", F.lit(","), "stance", F.lit(")")),
    ).otherwise(F.concat("raw_name", F.lit("("), "stance", F.lit(")")))
    listed = (
        links.join(heads, "analysis_id", "left_semi")
        .groupBy("analysis_id")
        .agg(F.array_sort(F.collect_list(F.struct("seq", label.alias("label")))).alias("items"))
        .select("analysis_id", F.array_join("items.label", "；").alias("targets"))
    )
    said = heads.join(analyses, "analysis_id", "left").join(listed, "analysis_id", "left")
    line = lambda prefix, c: F.when(
        F.length(strip(F.coalesce(c, F.lit("")))) > 0, F.concat(F.lit(prefix), strip(c))
    )
    details = F.concat_ws(
        "\n",
        line("总结：", F.col("summary")),
        F.when(F.col("targets").isNotNull(), F.concat(F.lit("标的："), "targets")),
        line("评级：", F.col("action")),
    )
    shown = said.select("report_id", details.alias("details"))
    header = F.concat(
        F.lit("券商="), "broker", F.lit(" 日期="), F.col("publish_date").cast("string"), F.lit(" 标题="), "title"
    )
    return reports.select(F.col("id").alias("report_id"), header.alias("header")).join(
        shown, "report_id", "left"
    )


def build_digests(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """One numbered text per theme over its evidence (at most one evidence set per theme)."""
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("[R"), F.col("position").cast("string"), F.lit("] "), "header"),
        F.nullif("details", F.lit("")),
    )
    return (
        evidence.join(blocks, "report_id")
        .groupBy("theme_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("blocks"))
        .select("theme_id", F.size("blocks").alias("n_reports"), F.array_join("blocks.b", "\n\n").alias("digest"))
    )


def known_codes(evidence: DataFrame, reports: DataFrame, links: DataFrame) -> DataFrame:
    """(theme_id, code): resolved codes of the evidence, the codes a synthesis may name."""
    heads = reports.select(F.col("id").alias("report_id"), F.col("current_analysis_id").alias("analysis_id"))
    coded = (
        links.where("target_code IS NOT NULL")
        .select("analysis_id", F.col("target_code").alias("code"))
        .distinct()
        .join(heads, "analysis_id")
    )
    return evidence.select("theme_id", "report_id").join(coded, "report_id").select("theme_id", "code").distinct()


def _references(listed: Column, n_reports: Column) -> Column:
    """Citation numbers as whole numbers within 1..n, sorted, each once.

    Fractions are cut, ``true`` counts as 1, text must be a whole number.
    """
    refs = F.coalesce(
        F.try_variant_get(listed, "$", "array<variant>"), F.array().cast("array<variant>")
    )

    def whole(r: Column) -> Column:
        kind = F.schema_of_variant(r)
        number = F.try_variant_get(r, "$", "double")
        return (
            F.when(kind == "STRING", F.translate(strip(F.try_variant_get(r, "$", "string")), "０１２３４５６７８９", "0123456789").try_cast("bigint"))
            .when(kind == "BOOLEAN", F.try_variant_get(r, "$", "boolean").cast("bigint"))
            .when(kind.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))
        )

    numbers = F.transform(refs, whole)
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda v: v.between(1, n_reports))))


def cited_items(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per statement that survives: (theme_id, part, position, text, code, view, refs).

    ``answers``: theme_id, payload (variant), n_reports. Statements without text or without a
    valid citation are dropped.
    """
    said = "text:string,name:string,code:string,view:string,report_refs:variant"
    lists = F.try_variant_get(
        payload, "$", "struct<common_conclusions:variant,consensus_targets:variant,divergences:variant>"
    )
    none = F.lit(None).cast("string")

    def statements(part: str) -> Column:
        targets = part == "consensus_targets"
        return F.filter(
            F.transform(
                objects(F.col("_lists")[part], said),
                lambda e, i: F.struct(
                    F.lit(part).alias("part"),
                    i.alias("position"),
                    strip(F.coalesce(e["name" if targets else "text"], F.lit(""))).alias("text"),
                    (normalize_code(e["code"]) if targets else none).alias("code"),
                    (F.coalesce(e["view"], F.lit("")) if targets else F.lit("")).alias("view"),
                    _references(e["report_refs"], F.col("n_reports")).alias("refs"),
                ),
            ),
            lambda s: (s["text"] != "") & (F.size(s["refs"]) > 0),
        )

    every = F.concat(*[statements(p) for p in ("common_conclusions", "consensus_targets", "divergences")])
    return answers.withColumn("_lists", lists).select("theme_id", F.inline(every))


def keep_known_codes(items: DataFrame, codes: DataFrame) -> DataFrame:
    """A code outside the evidence becomes NULL; the statement stays."""
    allowed = codes.select("theme_id", "code", F.lit(True).alias("_known")).distinct()
    return (
        items.join(allowed, ["theme_id", "code"], "left")
        .withColumn("code", F.when(F.col("_known"), F.col("code")))
        .drop("_known")
    )


def detail_view(syntheses: DataFrame, reports: DataFrame) -> DataFrame:
    """Evidence of a synthesis in citation order. Deleted reports still show; only rows that no
    longer exist get the placeholder."""
    rows = reports.select(F.col("id").alias("report_id"), "title", "broker", "publish_date")
    return (
        syntheses.select("synthesis_id", F.posexplode("report_ids").alias("_pos", "report_id"))
        .join(rows, "report_id", "left")
        .select(
            "synthesis_id",
            (F.col("_pos") + 1).alias("position"),
            "report_id",
            F.coalesce("title", F.concat(F.lit("#"), F.col("report_id").cast("string"), F.lit("（已删除）"))).alias("title"),
            F.coalesce("broker", F.lit("")).alias("broker"),
            F.coalesce("publish_date", F.lit("1970-01-01").cast("date")).alias("publish_date"),
        )
    )
