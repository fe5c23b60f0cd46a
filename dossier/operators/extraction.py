"""Saved extractor responses -> typed results -> versioned analyses and their projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import blank_to_null, strip
from .numbering import numbered_within


def repair_json(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``payload`` (an object variant) or ``error``.

    A code fence is removed; a text that is not JSON as a whole falls back to its outermost braces.
    """
    text = strip(F.coalesce(F.col(raw), F.lit("")))
    unfenced = F.when(
        text.startswith("```"),
        F.regexp_replace(
            F.regexp_replace(text, r"(?U)^```[a-zA-Z0-9_-]*\s*\n?", ""), r"(?U)\n?```\s*$", ""
        ),
    ).otherwise(text)
    braces = F.nullif(F.regexp_extract("_text", r"(?s)\{.*\}", 0), F.lit(""))
    parsed = F.coalesce(F.try_parse_json("_text"), F.try_parse_json(braces))
    # only an object reads as a struct, whatever fields it has
    is_object = F.try_variant_get("_parsed", "$", "struct<x:variant>").isNotNull()
    return (
        responses.withColumn("_text", unfenced)
        .withColumn("_parsed", parsed)
        .withColumn("payload", F.when(is_object, F.col("_parsed")))
        .withColumn("error", F.when(~is_object, "llm_invalid_json"))
        .drop("_text", "_parsed")
    )


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _strict_bool(value: Column) -> Column:
    """True/False only for a JSON boolean, NULL for anything else."""
    return F.when(
        F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")
    )


def objects(items: Column, fields_ddl: str) -> Column:
    """The objects of a JSON list as structs of the given fields; other items are NULL."""
    listed = F.coalesce(
        F.try_variant_get(items, "$", "array<variant>"), F.array().cast("array<variant>")
    )
    return F.transform(listed, lambda e: F.try_variant_get(e, "$", f"struct<{fields_ddl}>"))


#: JSON false and zero as texts
_FALSY = ["false", "0", "0.0", "-0", "-0.0"]


def _said(text: Column, value: Column) -> Column:
    """The text of a JSON value; false and zero say nothing, a string "0" does."""
    return F.when(text.isin(_FALSY) & (F.schema_of_variant(value) != "STRING"), None).otherwise(text)


def _named(items: Column, fields_ddl: str) -> Column:
    ddl = f"name:string,{fields_ddl}"
    listed = F.coalesce(
        F.try_variant_get(items, "$", "array<variant>"), F.array().cast("array<variant>")
    )
    read = F.transform(
        listed, lambda e: F.struct(e.alias("v"), F.try_variant_get(e, "$", f"struct<{ddl}>").alias("s"))
    )

    def said(x: Column) -> Column:
        fields_ = [f.split(":") for f in ddl.split(",")]
        return F.struct(
            *(
                (_said(x["s"][name], F.try_variant_get(x["v"], f"$.{name}", "variant")) if kind == "string" else x["s"][name]).alias(name)
                for name, kind in fields_
            )
        )

    return F.filter(
        F.transform(F.filter(read, lambda x: x["s"].isNotNull()), said),
        lambda e: strip(_text(e["name"])) != "",
    )


_PAYLOAD = (
    "struct<broker:string,publish_date:string,report_type:string,title:string,summary:string,"
    "risk_notes:string,rating:variant,targets:variant,themes:variant,authors:variant>"
)


def normalize_result(analyses: DataFrame, payload: str = "payload", body: str = "body") -> DataFrame:
    """Add the typed ``result``; what drifts in one field never fails the whole row.

    List fields that hold a bare number or ``true`` cannot be walked: ``schema_error`` is set.
    """
    p, text = F.col("_p"), F.col(body)
    told = lambda name: _text(_said(p[name], F.try_variant_get(payload, f"$.{name}", "variant")))
    # a list field that is a bare number but zero, or true
    unwalkable = F.lit(False)
    for name in ("targets", "themes", "authors"):
        kind = F.schema_of_variant(p[name])
        unwalkable = unwalkable | (
            kind.rlike("^(?:BIGINT|DOUBLE|DECIMAL|BOOLEAN)")
            & (F.try_variant_get(p[name], "$", "double") != 0)
        )
    prepared = (
        analyses.withColumn("_p", F.try_variant_get(payload, "$", _PAYLOAD))
        .withColumn("_anchored", fields.anchor_publish_date(text))
        .withColumn("_extracted", fields.extracted_date(told("publish_date")))
        .withColumn("_rating", F.try_variant_get(p["rating"], "$", "struct<action:string,maintained:variant>"))
        .withColumn("schema_error", F.when(F.coalesce(unwalkable, F.lit(False)), "schema_invalid"))
    )
    coded = F.transform(
        _named(p["targets"], "code:string,stance:string,view:string,has_forecast:variant"),
        lambda e: F.struct(e.alias("e"), fields.normalize_code(_text(e["code"])).alias("code")),
    )
    targets = F.transform(
        coded,
        lambda c: F.struct(
            c["code"].alias("code"),
            strip(c["e"]["name"]).alias("name"),
            fields.map_stance(_text(c["e"]["stance"])).alias("stance"),
            _text(c["e"]["view"]).alias("view"),
            F.coalesce(_strict_bool(c["e"]["has_forecast"]), F.lit(False)).alias("has_forecast"),
            fields.code_source(c["code"], text).alias("code_source"),
        ),
    )
    themes = F.transform(
        _named(p["themes"], "reason:string"),
        lambda e: F.struct(strip(e["name"]).alias("name"), _text(e["reason"]).alias("reason")),
    )
    authors = F.transform(
        _named(p["authors"], "cert:string"),
        lambda e: F.struct(strip(e["name"]).alias("name"), blank_to_null(e["cert"]).alias("cert")),
    )
    publish_date, source = fields.date_provenance(F.col("_anchored"), F.col("_extracted"))
    result = F.struct(
        told("broker").alias("broker"),
        authors.alias("authors"),
        publish_date.alias("publish_date"),
        fields.map_report_type(told("report_type")).alias("report_type"),
        told("title").alias("title"),
        told("summary").alias("summary"),
        themes.alias("themes"),
        targets.alias("targets"),
        F.struct(
            fields.map_action(F.col("_rating.action")).alias("action"),
            _strict_bool(F.col("_rating.maintained")).alias("maintained"),
        ).alias("rating"),
        told("risk_notes").alias("risk_notes"),
        source.alias("publish_date_source"),
    )
    return prepared.withColumn(
        "result", F.when(F.col("schema_error").isNull(), result)
    ).drop("_p", "_anchored", "_extracted", "_rating")


def merge_partials(partials: DataFrame, scalars: list[str]) -> DataFrame:
    """Scalars of a chunked report: the earliest chunk that has a value decides."""
    return partials.groupBy("report_id").agg(
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chunk_no"))).alias(c)
            for c in scalars
        ]
    )


def merge_partial_items(items: DataFrame, key: list[str], view: str) -> DataFrame:
    """One row per report and key: the longest view is the most specific, then the earliest chunk."""
    rest = [c for c in items.columns if c not in ("report_id", *key)]
    best = F.max_by(F.struct(*rest), F.struct(F.length(view), -F.col("chunk_no"))).alias("_best")
    return items.groupBy("report_id", *key).agg(best).select("report_id", *key, "_best.*")


def append_versions(
    heads: DataFrame, batch: DataFrame, key: str, order: str
) -> DataFrame:
    """Number a batch of new versions after the highest version each key already has.

    ``heads`` holds (key, version) of what exists; the highest new version is the new head.
    """
    known = heads.groupBy(key).agg(F.max("version").alias("_last"))
    newest = batch.groupBy(key).agg(F.max(order).alias("_newest"))
    numbered = numbered_within(batch, [key], [F.col(order)], "_n")
    return (
        numbered.join(known, key, "left")
        .join(newest, key)
        .withColumn("version", F.coalesce("_last", F.lit(0)) + F.col("_n"))
        .withColumn("is_head", F.col(order) == F.col("_newest"))
        .drop("_n", "_last", "_newest")
    )


def author_projection(analyses: DataFrame, authors: str = "authors") -> DataFrame:
    """(analysis, seq, name, cert): blank names skipped, seq without gaps, blank cert is NULL."""
    named = F.filter(F.col(authors), lambda a: strip(F.coalesce(a["name"], F.lit(""))) != "")
    return analyses.select(
        "analysis_id", "report_id", F.posexplode(named).alias("seq", "a")
    ).select(
        "analysis_id",
        "report_id",
        "seq",
        strip(F.col("a.name")).alias("name"),
        blank_to_null(F.col("a.cert")).alias("cert"),
    )


def theme_projection(analyses: DataFrame, themes: str = "themes") -> DataFrame:
    """(analysis, seq, raw_name, reason): blank names skipped, seq without gaps."""
    named = F.filter(F.col(themes), lambda a: strip(F.coalesce(a["name"], F.lit(""))) != "")
    return analyses.select(
        "analysis_id", "report_id", F.posexplode(named).alias("seq", "a")
    ).select(
        "analysis_id",
        "report_id",
        "seq",
        strip(F.col("a.name")).alias("raw_name"),
        F.coalesce("a.reason", F.lit("")).alias("reason"),
    )


def target_projection(analyses: DataFrame, targets: str = "targets") -> DataFrame:
    """(analysis, seq, target fields): seq is the position in the array."""
    return analyses.select(
        "analysis_id", "report_id", F.posexplode(targets).alias("seq", "a")
    ).select("analysis_id", "report_id", "seq", "a.*")


def plan_reanalysis(requests: DataFrame, reports: DataFrame, bodies: DataFrame) -> DataFrame:
    """Requested ids, first mention only -> ready with its file, or the reason to skip."""
    live = reports.where(~F.col("deleted")).select(F.col("id").alias("report_id"), F.lit(True).alias("_live"))
    wanted = requests.groupBy("report_id").agg(F.min("position").alias("position"))
    return (
        wanted.join(live, "report_id", "left")
        .join(bodies.select("report_id", "file_id"), "report_id", "left")
        .select(
            "position",
            "report_id",
            F.when(F.col("_live"), F.col("file_id")).alias("file_id"),
            F.when(F.col("_live").isNull(), "not_found")
            .when(F.col("file_id").isNull(), "markdown_missing")
            .otherwise("ready")
            .alias("plan"),
        )
    )
